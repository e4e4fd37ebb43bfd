import random
import re
from collections import Counter, defaultdict

import duckdb

from kinolake.llm import divergence as D


def brute(rows, min_docs=30, top=50):
    docs, own = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(found))
        own[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        langs = Counter()
        for g in groups:
            if g[0] == lang:
                langs.update({t: own[g][t] for t in kept})
        p = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        mine, q = p(own[lang, source]), p(langs)
        pairs = [(s, sum(abs(mine[t] - p(own[lang, s])[t]) for t in kept)) for o, s in groups if o == lang and s != source]
        terms = [(t, mine[t] - q[t]) for t in kept if own[lang, source][t] > 0 and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def rows():
    rnd = random.Random(2)
    words = [*"abcdefgh", "Été", "ß1x", "ÀB", "Z_z", "don't", "日本"]
    made = [(i, " ".join(rnd.choice(words[: rnd.randrange(1, 14)]) for _ in range(rnd.randrange(40))), rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["s1", "s2", None, "S", "é"])) for i in range(300)]
    return made + [(1, None, "en", "void"), (1, "", "xx", "s1"), (None, "1 2 3 a", "xx", "s2"), (2, "a a a", "yy", "s1"), (2, "a a a", "yy", "s1"), (3, "Long " * 20000, "en", "s1")]


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_against_brute_force(documents):
    made = rows()
    want = brute(made)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want)
    assert got(D.divergence(documents(made))) == want


def test_against_sql(documents, spark):
    con = duckdb.connect()
    con.register("documents", documents(rows()).toPandas())
    assert sorted(con.sql(D.ORACLE).fetchall()) == got(D.divergence(documents(rows())))


def test_few_kept_terms(documents):
    made = [(i, f"t{i % 7} common", "en", f"s{i % 3}") for i in range(60)]
    assert got(D.divergence(documents(made), min_docs=9, top=1)) == brute(made, 9, 1)


def test_large_totals_are_exact(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    made = [(rnd.randrange(10**13), 0, rnd.randrange(1, 10**7)) for _ in range(300)]
    made = [(c, c + rnd.randrange(10**14), v) for c, _, v in made]
    df = spark.createDataFrame(made, "c bigint, n bigint, v bigint")
    assert [r[0] for r in df.select(D.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in made]


def test_empty_table(documents):
    assert D.divergence(documents([])).count() == 0
