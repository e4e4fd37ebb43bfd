import hashlib
import re

from kinolake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


TEXTS = [
    None, "", "no data here", "é mail a.b+c@x-y.example.com, also a@b and q@r.st.uv.", "a@b.c_x@d.e and a@b.c.d@e.f.g",
    "ip 10.0.0.255 not 10.0.0.256 nor 1.2.3; chain 1.2.3.4.5.6.7.8 and 999.1.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 5",
    "- 4111 1111 1111 1111 -", "4111  1111 1111 1111", "phone +49 (30) 1234-5678 and +1 23 and +44.20.7946.0958.", "+1 2345 6789 4111 1111 1111 1111 x@y.zz",
    "ñ" * 50 + " +34 912 345 678 " + "ü", "..a@b.c..d@e.f..", "1" * 3000 + " " + "2 " * 3000, "@@ a@@b.c @a.b %@x.y", "000001.2.3.4 0.0.0.0 00000000255.1.1.1",
]


def test_base_spans_as_brute_force(documents):
    df = documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[6])])
    rows = pii.detect(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r["doc_id"] if r["doc_id"] is not None else 6]
        spans = brute(text)
        assert r["spans"].split(",") == (spans or [""])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]


def test_disclosing_terms_go_and_clean_documents_stay(documents):
    own = [(i, f"word{i} the boss Quillfeather wrote to boss@corp.example today about w{i * 7}") for i in range(6)]
    clean = [(100 + i, f"the today about wrote to nothing {i}") for i in range(40)]
    rows = {r["doc_id"]: r["spans"] for r in pii.detect(documents(own + clean)).collect()}
    for i, text in own:
        at = text.index("Quillfeather")
        assert f"remove:{at}:{at + 12}" in rows[i]
        assert f"remove:{text.index('today')}" not in rows[i]
    assert all(rows[i] == "" for i, _ in clean)
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(own + clean)).collect()}
    assert "Quillfeather" not in texts[0] and "<EMAIL>" in texts[0] and texts[100] == clean[0][1]


def test_empty_table(documents):
    assert pii.detect(documents([])).count() == 0


def brute_spans(texts, around=pii.CONTEXT):
    """Added spans of each text, by plain loops: {index: {(kind, start, end)}}."""
    import math

    contexts = []
    for i, text in enumerate(texts):
        text = text or ""
        for k, p in PATTERNS.items():
            for m in re.finditer(p, text):
                if good(k, m[0]):
                    lo, hi = max(0, m.start() - around), m.end() + around
                    terms = [(t[0].lower(), lo + t.start(), lo + t.end()) for t in re.finditer(r"\w{2,}", text[lo : m.start()])]
                    terms += [(t[0].lower(), m.end() + t.start(), m.end() + t.end()) for t in re.finditer(r"\w{2,}", text[m.end() : hi])]
                    terms = [t for t in terms if (t[1] > lo or t[1] == 0) and t[2] < hi]
                    contexts.append((i, (k, m[0].lower()), text[lo : m.start()] + "\0" + text[m.end() : hi], terms))
    n, out = len(texts), {}
    holds = {}
    for i, text in enumerate(texts):
        for t in set(re.findall(r"\w{2,}", (text or "").lower())):
            holds.setdefault(t, set()).add(i)
    for entity in {c[1] for c in contexts}:
        own = [c for c in contexts if c[1] == entity]
        n_e = len({c[0] for c in own})
        if len({c[2] for c in own}) < pii.SUPPORT or n_e == n:
            continue
        for term in {t[0] for c in own for t in c[3]}:
            hold = [c for c in own if any(t[0] == term for t in c[3])]
            if len({c[2] for c in hold}) < pii.SUPPORT:
                continue
            part = math.log2(len({c[0] for c in hold}) * n / (n_e * len(holds[term]))) / math.log2(n / n_e)
            if part >= pii.GENERALISE:
                for c in hold:
                    for t in c[3]:
                        if t[0] == term:
                            out.setdefault(c[0], {}).setdefault(t[1:], set()).add("remove" if part >= pii.REMOVE else "generalise")
    for i, places in out.items():
        base = [tuple(map(int, s.split(":")[1:])) for s in brute(texts[i])]
        out[i] = {(max(kinds), a, b) for (a, b), kinds in places.items() if not any(x < b and a < y for x, y in base)}
    return out


def test_added_spans_as_brute_force(documents):
    import random

    random.seed(11)
    people = [("ann@a.example", "Quill"), ("10.1.2.3", "rackname"), ("+49 30 123456", "Hotline9"), ("bob.b@b.example", "1984")]
    texts = []
    for i in range(120):
        words = [random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + random.choice(["", "x", str(i)]) for _ in range(random.randint(0, 40))]
        for _ in range(random.randint(0, 3)):
            entity, term = random.choice(people)
            at = random.randint(0, len(words))
            words[at:at] = random.choice([[entity, term], [term, "of", entity], [entity], [entity, "and", "10.1.2.3", term]])
        if random.random() < 0.02:
            words.append("rackname")
        texts.append(" ".join(words))
    want = brute_spans(texts)
    assert sum(map(len, want.values())) > 20
    for r in pii.detect(documents(list(enumerate(texts)))).collect():
        got = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k in ("remove", "generalise")}
        assert got == want.get(r["doc_id"], set()), texts[r["doc_id"]]


def test_a_text_of_thirty_thousand_entities_among_ordinary_rows(documents):
    big = " ".join(f"user{i}@mail{i % 97}.example from 10.{i % 200}.{i % 250}.7" for i in range(15_000))
    plain = [(i, f"boss@corp.example wrote word{i % 50} to Quillfeather {i}") for i in range(300)]
    got = {r["doc_id"]: r for r in pii.sanitise(documents([*plain, (1000, big), (1001, None)])).collect()}
    assert got[1000]["text"].count("<EMAIL>") == got[1000]["text"].count("<IP>") == 15_000
    row = pii.detect(documents([*plain, (1000, big)])).where("doc_id = 1000").first()
    assert (row["n_email"], row["n_ip"]) == (15_000, 15_000)
    assert row["base_sha256"] == hashlib.sha256(",".join(brute(big)).encode()).hexdigest()
    assert "<EMAIL>" in got[0]["text"] and got[1001]["text"] == ""
