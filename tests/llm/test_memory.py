"""Texts whose shape could take much memory, in processes of their own."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])


def peak_mb(code):
    """What the process holds at most, less what it holds before the work."""
    lines = f"import resource, sys\nsys.path.insert(0, {ROOT!r})\n" + code
    out = subprocess.run([sys.executable, "-c", lines], capture_output=True, text=True, timeout=600, check=True)
    return float(out.stdout.split()[-1])


HELD = "resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024"


def test_a_repetitive_item_and_text():
    code = f"""
import numpy as np
from kinolake.llm import decontaminate as C
cache = C.TemplateWords()
def items(*texts):
    made = [C.item_windows(t, cache, 3) for t in texts]
    per = lambda values: np.concatenate([np.full(len(m[0]), v) for m, v in zip(made, values)])
    h, at, rank, slots = (np.concatenate([m[i] for m in made]) for i in range(4))
    order = np.argsort(h, kind="stable")
    return C.Items([], h[order], *(x[order] for x in (per(range(len(texts))), per([m[1].max() + 1 for m in made]), per([m[4] for m in made]), at, rank, slots)))
own = items(b"ping " * 60, b"7 " * 59 + b"8")
before = {HELD}
assert own.contaminants(b"ping " * 1_000_000, cache) == [0]
assert own.contaminants(b"7 " * 300_000, cache) == [1]
print({HELD} - before)
"""
    assert peak_mb(code) < 500


def test_one_very_long_word():
    code = f"""
import numpy as np
from kinolake.llm import language_id as L
scorer = L.Scorer(["\\u2581a", "ab", "b", "abab", "a"], np.log(np.full((4, 5), 0.2)))
before = {HELD}
s = scorer.score(b"ab" * 1_000_000)
assert s[-1] == 1 and np.isfinite(s).all()
print({HELD} - before)
"""
    assert peak_mb(code) < 500
