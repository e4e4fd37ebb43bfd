from kinolake.llm import decontaminate as C

ITEM = "A train leaves Boston at 10 km and reaches Denver after 25 minutes while Boston waits for its passengers to come back home"
SWAP = "A train leaves Paris at 17 km and reaches London after 99 minutes while Paris waits for its passengers to come back home"
BROKEN = "A train leaves Paris at 17 km and reaches London after 99 minutes while Tokyo waits for its passengers to come back home"
SHORT = "seven plain words here make no window"
WHOLE = "nine quite plain little words stand here for testing"


def run(documents, spark, rows, items, **kw):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], i): r["item_ids"] for i, r in enumerate(C.decontaminate(documents(rows), bench, **kw).orderBy("doc_id").collect()) if r["contaminated"]}


def test_templates_slots_and_edges(documents, spark):
    items = [(1, ITEM), (2, SHORT), (3, WHOLE), (4, None), (None, ITEM), (5, "")]
    rows = [
        (10, f"intro text. {ITEM} and more text follows here"), (11, f"Intro text. {SWAP} and more"), (12, f"Intro text. {BROKEN} and more"), (13, SHORT), (14, f"so {WHOLE} it goes"),
        (15, None), (16, ""), (17, "reaches Denver after 25 minutes while"), (18, ITEM.lower().replace("boston", "Boston").replace("denver", "Denver")), (19, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
        (20, "word " * 30_000 + SWAP), (21, "clean text about nothing that a benchmark holds, in many words of its own"), (None, ITEM), (10, f"intro text. {ITEM} and more text follows here"),
    ]
    near = run(documents, spark, rows, items)
    far = run(documents, spark, rows, items, broadcast_windows=0)
    assert near == far
    hit = {}
    for (doc, _), ids in near.items():
        hit.setdefault(doc, []).append(ids)
    assert hit == {None: [[1]], 10: [[1], [1]], 11: [[1]], 14: [[3]], 18: [[1]], 20: [[1]]}


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert C.decontaminate(documents([(1, ITEM)]), none).first()["contaminated"] is False
    assert C.decontaminate(documents([]), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")).count() == 0


TITLE = "The Quick Brown Fox Jumps Over The Lazy Dog And Runs Back To Its Den"
NUMBERS = "Compute 3 7 12 19 28 39 52 67 84 103 124 147 172 199 228"
#: Usable windows of two runs of under six each, between names and numbers.
BROKEN_RUNS = "we see that some old men took Anna Bob Carl Dora Emil 5 6 7 8 and then their new boat went away"


def test_verbatim_copies_of_few_literals(documents, spark):
    tokens, slots = C.template(BROKEN_RUNS.encode(), C.TemplateWords())[:2]
    usable = C.windows(tokens, slots)[1]
    assert usable.sum() >= 6 and C.longest_run([int(i) for i in usable.nonzero()[0]]) < 6
    items = [(1, TITLE), (2, NUMBERS), (3, BROKEN_RUNS)]
    rows = [(i, f"Before it. {text} and after") for i, text in items]
    rows += [(11, f"as said, {TITLE.lower()} it was"), (12, "Before it. " + " ".join(TITLE.split()[:12])), (13, "Before it. " + NUMBERS.replace("84", "85"))]
    rows += [(14, f"Before it. {BROKEN_RUNS.replace('Carl', 'Otto').replace(' 7 ', ' 9 ')} and after")]
    near, far = run(documents, spark, rows, items), run(documents, spark, rows, items, broadcast_windows=0)
    assert near == far
    assert {doc: ids for (doc, _), ids in near.items()} == {1: [1], 2: [2], 3: [3], 11: [1], 14: [3]}


def test_first_word_may_be_a_name_inside_a_document(documents, spark):
    plain = "Nine quite plain little words stand here for testing"
    slots = "Paul quickly counts 5 red balls beside the garden wall"
    items = [(1, plain), (2, slots)]
    rows = [(1, f"so {plain} it goes"), (2, f"a heading\n{plain}"), (3, f"then, {slots.replace('5', '7')} again"), (4, slots.replace("Paul", "Anna")), (5, f"so {plain.replace('testing', 'nothing')} it goes")]
    near, far = run(documents, spark, rows, items), run(documents, spark, rows, items, broadcast_windows=0)
    assert near == far
    assert {doc: ids for (doc, _), ids in near.items()} == {1: [1], 2: [1], 3: [2]}


def test_short_items_match_by_all_their_words(documents, spark):
    items = [(1, SHORT), (2, "What is Ohm's law?"), (3, "two words"), (4, "Seven plain words")]
    rows = [(1, f"so {SHORT.title()}, it goes"), (2, "he asked: what is ohm's LAW"), (3, "two words"), (4, "what is a law"), (5, SHORT.replace("window", "door")), (6, "What is Ohm's law?"), (7, None)]
    near, far = (run(documents, spark, rows, items, shortest=C.SHORTEST, **kw) for kw in ({}, {"broadcast_windows": 0}))
    assert near == far
    assert {doc: ids for (doc, _), ids in near.items()} == {1: [1, 4], 2: [2], 5: [4], 6: [2]}


def test_letters_that_are_units_only_behind_numbers():
    cache = C.TemplateWords()
    tokens, slots, _ = C.template(b"in a box of 5 in and 7 m we see a cat", cache)
    assert [i for i, v in enumerate(slots) if v] == [4, 5, 7, 8]


def brute(items, rows, shortest):
    """Contaminating items of each text by plain loops over places, without hashes of windows."""
    cache = C.TemplateWords()

    def shape(text, first=False):
        tokens, slots, words = (x.tolist() for x in C.template((text or "").encode(), cache, first))
        return list(zip(tokens, slots, words, strict=True))

    def same_template(a, b):
        x, y = [p[1] for p in a], [p[1] for p in b]
        alike = [p[0] for p in a] == [p[0] for p in b]
        return alike and sum(v > 0 for v in x) <= 4 and all((x[i] == x[j]) == (y[i] == y[j]) for i in range(8) for j in range(8) if x[i] and x[j])

    def exact(a, b):
        return [p[2] for p in a] == [p[2] for p in b]

    out = {}
    for k, text in rows:
        doc, found = shape(text), set()
        for item, words in items:
            own = shape(words)
            named = shape(" ".join(words.split()[:8]), True)
            n = len(own)
            if shortest <= n < 8:
                if any(exact(own, doc[at : at + n]) for at in range(len(doc) - n + 1)):
                    found.add(item)
                continue
            usable = sum(sum(p[1] > 0 for p in own[i : i + 8]) <= 4 for i in range(n - 7))
            order = [i for i in range(n - 7) if sum(p[1] > 0 for p in own[i : i + 8]) <= 4]
            for shift in range(-n, len(doc)):
                like, same = {}, {}
                for i in range(n - 7):
                    at = i + shift
                    if 0 <= at <= len(doc) - 8:
                        piece = doc[at : at + 8]
                        if same_template(own[i : i + 8], piece):
                            like[i] = (own[i : i + 8], piece)
                        elif i == 0 and own[0][1] != named[0][1] and 0 in order and same_template(named, piece):
                            like[i] = (named, piece)
                        if exact(own[i : i + 8], piece):
                            same[i] = (own[i : i + 8], own[i : i + 8])
                for places, most, pairs in (
                    (set(like) | set(same), n - 7, [*like.values(), *same.values()]), ({order.index(i) for i in like if i in order}, usable, list(like.values())), (set(same), n - 7, list(same.values())),
                ):
                    values = {(a[1], b[1]) for x, y in pairs for a, b in zip(x, y, strict=True) if a[1]}
                    one = len(values) == len({a for a, _ in values}) == len({b for _, b in values})
                    if places and one and C.longest_run(list(places)) >= min(6, most):
                        found.add(item)
        out[k] = sorted(found)
    return out


def test_as_brute_force(documents, spark):
    import random

    rnd = random.Random(8)
    vocab = "the a in of red green box cat runs over under with Anna Bob Carl 3 5 7 12 km m kg and then".split()
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, make(rnd.choice([2, 4, 6, 9, 12, 18, 25]))) for i in range(25)]
    swap = {"Anna": "Dora", "Bob": "Emil", "Carl": "Fritz", "3": "44", "5": "55", "7": "77", "12": "9"}
    rows = []
    for k in range(150):
        _, text = rnd.choice(items)
        if rnd.random() < 0.5:
            text = " ".join(swap.get(w, w) for w in text.split())
        if rnd.random() < 0.3:
            text = " ".join(w if rnd.random() < 0.97 else rnd.choice(vocab) for w in text.split())
        rows.append((k, f"{make(rnd.randint(0, 12))}{rnd.choice([' ', '. '])}{text} {make(rnd.randint(0, 12))}"))
    want = brute(items, rows, C.SHORTEST)
    assert sum(map(bool, want.values())) > 40
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for kw in ({}, {"broadcast_windows": 0}):
        got = {r["doc_id"]: r["item_ids"] for r in C.decontaminate(documents(rows), bench, shortest=C.SHORTEST, **kw).collect()}
        assert got == want


def test_repetitive_items_and_texts_as_brute_force(documents, spark, monkeypatch):
    """Few words, so windows meet in many places; pairs are judged a few at a time."""
    import random

    monkeypatch.setattr(C, "HITS", 13)
    rnd = random.Random(5)
    make = lambda n, vocab: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, make(rnd.choice([8, 10, 14, 20]), ["a", "b", "3"][: 1 + i % 3])) for i in range(9)]
    rows = [(k, make(rnd.randrange(45), ["a", "b", "3", "4"][: 1 + k % 4])) for k in range(40)]
    want = brute(items, rows, C.SHORTEST)
    assert any(want.values()) and not all(want.values())
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for kw in ({}, {"broadcast_windows": 0}):
        got = {r["doc_id"]: r["item_ids"] for r in C.decontaminate(documents(rows), bench, shortest=C.SHORTEST, **kw).collect()}
        assert got == want
