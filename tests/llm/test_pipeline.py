import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from kinolake.llm import language_id, mixing, ngram_join, token_output

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas()
    langs = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        after = out.toPandas()
        if name == "language_id":
            assert set(after["doc_id"]) == {i for i, r in langs.items() if r["lang_pred"] != "und" and r["score"] >= P.LEAST_SCORE}
        elif name == "ngram_join":
            comp = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs).collect()}
            assert sorted(after["doc_id"]) == sorted(set(comp.values())) and len(after) < len(before)
        elif name == "decontaminate":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]
            full = {i for i, t in zip(before["doc_id"], before["text"], strict=True) if any(x in (t or "") for x in items)}
            assert full.isdisjoint(after["doc_id"]) and len(before) - len(after) <= len(full) + 1
        else:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
            words = after.assign(n=after["text"].str.split(r"[\x20\x09-\x0D]+", regex=True).map(lambda w: sum(map(bool, w)))).groupby("doc_id")["n"].sum()
            assert words.to_dict() == taken
        docs = spark.createDataFrame(after, docs.schema)
        before = after


def test_run_gives_token_files_of_the_mix(spark):
    rows = sorted(P.run(spark, SF).collect(), key=lambda r: r["start"])
    assert rows and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False)) and rows[0]["start"] == 0
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    tokenizer = Tokenizer.from_file(token_output.vocabulary())
    whole = {i: zlib.crc32(np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i in {r["doc_id"] for r in rows}}
    assert sum(whole[r["doc_id"]] == r["ids_crc32"] for r in rows) >= 0.8 * len(rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("row", [(1, None, None, None, None), (2, "", "en", None, 0)])
def test_rows_without_text_are_rejected(spark, row):
    docs = spark.createDataFrame([row], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert P.identify(spark, docs, SF).count() == 0


def test_null_and_repeated_doc_ids_stay(spark):
    """Rows without a doc_id, and several texts under one doc_id, go through all stages like others; reruns agree."""
    import random

    rnd = random.Random(2)
    vocab = {"en": "the cat and dog with that this from have were they will would there their which when".split(), "de": "der die und nicht von auf mit dem sich auch eine werden oder einem sind haben nach".split()}
    text = lambda lang: " ".join(rnd.choice(vocab[lang]) for _ in range(40))
    rows = [(i if i % 9 else None, text(lang), lang, "ab"[i % 2], None) for i in range(60) for lang in ("en", "de")]
    rows += [rows[5], rows[5], (None, rows[8][1], "en", "a", None), (3, None, "en", "a", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one = P.identify(spark, docs, SF)
    assert one.count() == len(rows) - 2
    two = P.near_duplicates(spark, one, SF)
    assert sorted(map(repr, two.collect())) == sorted(map(repr, P.near_duplicates(spark, one.repartition(5), SF).collect()))
    texts = [r["text"] for r in two.collect()]
    assert sorted(texts) == sorted({r[1] for r in rows if r[1]})
    assert sum(r["doc_id"] is None for r in two.collect()) >= 10
    three = P.clean_of_benchmarks(spark, two, SF)
    assert three.count() == two.count()
    four = P.mixed(spark, three, SF)
    taken = sum(r["taken"] for r in mixing.mix(three).collect())
    assert sum(len(r["text"].split()) for r in four.collect()) == taken > 0
    again = P.mixed(spark, three.repartition(3), SF)
    assert [repr(r) for r in four.collect()] == [repr(r) for r in again.collect()]
    # the seven slots or so alternate between the sources in the written order, instead of one source standing behind the other
    order = [r["source"] for r in four.collect()]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) >= 3
    assert P.tokens(spark, four, SF).count() == four.count()


CLASHES = "lang_pred score contaminated item_ids words slot rest row key size nth tie file place number none id hash at r c0 _words _slot _key _id component_id held_out".split()


def test_extra_columns_of_any_name(spark):
    """Columns named like the stages' own, with dots, and of a map type go through all stages unchanged."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = F.create_map(F.lit("k"), F.col("doc_id").cast("string"))
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES], odd.alias("a.map"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in P.STAGES[:-1]:
        out, without = stage(spark, docs, SF), stage(spark, plain, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        got = out.collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r["doc_id"], r["text"]) for r in without.collect()), name
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES) and all(r["a.map"] == {"k": str(r["doc_id"])} for r in got)
    assert P.tokens(spark, docs, SF).count() == 60


def test_rows_of_files_and_others_are_told_apart_alike(spark, tmp_path):
    """Equal rows, and rows with the same doc_id: one of each group stays, whether rows come from files or not."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words + " more", "en", "b", 2), (5, "quite another text of its own here", "en", "a", 3), (5, "one more with the same id as another", "en", "a", 4), (None, words, "en", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    for df in (docs, spark.read.parquet(str(tmp_path / "d"))):
        got = sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, df, SF).collect())
        assert got == sorted([(1, words), (5, rows[3][1]), (5, rows[4][1])])
