import math
from collections import Counter

import numpy as np

from kinolake.llm import language_id as G

EN = "the cat sat on the mat and the dog ran with them under that tree while this bird was singing there".split()
DE = "der hund und die katze sind nicht auf dem dach sondern unter einem baum mit vielen schönen blättern gewesen".split()


def text(words, seed, n=30):
    return " ".join(words[(seed * 7 + i * (seed % 5 + 1)) % len(words)] for i in range(n))


def test_forward_sums_all_segmentations():
    pieces = G.vocabulary()
    logs = np.array([G.learn(Counter(G.words_of(" ".join(w))), pieces) for w in (EN, DE)])
    scorer = G.Scorer(pieces, logs)
    index = {p: i for i, p in enumerate(pieces)}

    def brute(word, c):
        if not word:
            return 1.0
        return sum((math.exp(logs[c][index[word[:k]]]) if word[:k] in index else G.UNKNOWN if k == 1 else 0.0) * brute(word[k:], c) for k in range(1, min(len(word), G.LONGEST) + 1))

    for w in ("▁the", "▁blättern", "▁x漢y", "▁q"):
        got = scorer.words([w])[0]
        assert all(math.isclose(got[c], math.log(brute(w, c)), rel_tol=1e-9) for c in (0, 1))
    long = "▁" + "thedog" * 40
    twice = scorer.words([long])[0]
    assert np.isfinite(twice).all() and twice[0] > twice[1]
    assert abs(sum(math.exp(x) for x in logs[0]) - 1) < 1e-9


def test_held_out_accuracy_and_edges(documents):
    rows = [(i, text(EN, i), "en") for i in range(0, 120)] + [(i, text(DE, i), "de") for i in range(200, 320)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 ... !!", "en"), (1003, "the cat " * 20_000, None), (None, "der hund und die katze", "de"), (5, rows[5][1], "en")]
    got = G.language_id(documents(rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == (truth[r["doc_id"]] or "en") and 0.5 <= r["score"] <= 1
    assert any(r["held_out"] for r in got)


def test_nothing_to_learn_and_empty_table(documents):
    assert {r["lang_pred"] for r in G.language_id(documents([(1, "text", None), (2, None, "en")])).collect()} == {"und"}
    assert G.language_id(documents([])).count() == 0


def test_no_lower_case_piece_is_left_out():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) and (p := sp.id_to_piece(i)) == p.lower()]
    pieces = set(G.vocabulary())
    assert max(map(len, plain)) <= G.LONGEST
    assert {"▁relationship", "▁professional", "▁international"} <= pieces and max(map(len, pieces)) > 12


def test_long_words_are_learned_from():
    pieces = G.vocabulary()
    short, long = Counter({"▁" + "ab" * 30: 1}), Counter({"▁" + "ab" * 40: 1, "▁" + "the" * 700: 1})
    for counts in (short, long):
        logs = G.learn(counts, pieces)
        assert np.isfinite(logs).all() and abs(np.exp(logs).sum() - 1) < 1e-9
    index = {p: i for i, p in enumerate(pieces)}
    # in logarithms and in plain numbers the expected uses are the same
    word = "▁" + "ab" * 20
    arcs = [(i, j, index[word[i:j]]) for i in range(len(word)) for j in range(i + 1, min(len(word), i + G.LONGEST) + 1) if word[i:j] in index]
    flat, out = [1 / len(pieces)] * len(pieces), [0.0] * len(pieces)
    G._expect_long(len(word), arcs, 2, flat, out)
    own = np.exp(G.learn(Counter({word: 2}), pieces, rounds=1))
    assert np.allclose((np.array(out) + G.SMOOTH) / (np.array(out) + G.SMOOTH).sum(), own, rtol=1e-9)


def test_repeated_ids_and_the_bound_in_bytes(documents):
    rows = [(1, text(EN, 1), "en")] * 500 + [(1, text(DE, 2), "de")] * 3 + [(7, "x " * 5000, "xx")]
    langs, _, _ = G.train(documents(rows), most_bytes=4000)
    assert langs == ["de", "en"]
    kept = G.language_id(documents(rows), carry=True)
    assert kept.count() == len(rows) and kept.columns == [*documents(rows).columns, "lang_pred", "score"]
