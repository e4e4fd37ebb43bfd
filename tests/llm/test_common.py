import random

import pytest

from kinolake.llm import common as C


def union_find(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components_of_random_links(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(-50, 60), rnd.randrange(-50, 60)) for _ in range(70)] + [(3, 3)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find([(a, b) for a, b in links if a != b])


def test_an_ordered_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "stored", lambda df, name, free=False, f=C.stored: written.append(name) or f(df, name, free))
    chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in C.components(chain).collect()} == {0}
    assert len(written) <= 3 * 9 + 2  # three writes a round; rounds near the logarithm of 200


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bucketed_tables_leave_the_catalogue(spark):
    before = len(spark.catalog.listTables())
    df = C.bucketed(spark.range(100).withColumnRenamed("id", "run"), "x", "run")
    assert len(spark.catalog.listTables()) == before and df.count() == 100


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})

    with pytest.raises(ValueError):
        C.shared_dir(Session("spark://x:7077"))
    assert C.shared_dir(Session("local[4]"))
