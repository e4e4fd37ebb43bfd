import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("text-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return s


@pytest.fixture
def documents(spark):
    """Makes a documents table with extra columns of clashing names from (doc_id, text[, lang[, source]])."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, norm string, name string, key string, size int"

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), 1, "x", "y", "z", 5) for r in rows]
        return spark.createDataFrame(full, schema)

    return make
