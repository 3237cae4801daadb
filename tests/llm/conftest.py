import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])
# names that operators use for columns of their own
CLASHES = ["key", "norm", "slot", "size", "label", "id", "rep", "band", "sketch", "n_shingles", "length", "_rank", "tokens", "epoch", "h1", "k",
           "covered", "s", "n_words", "bad", "kept", "row", "n_bytes", "shard_depth", "sequence_id", "start",
           "_gone", "_gone_id", "_Gone_sha", "_sha", "_epochs", "_cut_key", "_copies", "norm_", "_id", "_text", "_y"]


def words(n, seed=0, size=900):
    """Invented words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(size)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with extra columns if asked for."""
    def make(rows, extra=False):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")), None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(4)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in CLASHES})
        return df
    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    schema = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])
    return lambda rows: spark.createDataFrame([(a, b, 0) for a, b in rows], schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, repeated ids, one long text."""
    long = " ".join(words(30_000, seed=3, size=5000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (5, "ONE"), (None, "one"), (None, None), (6, "a b c d e f"), (6, "other text here"),
            (7, long), (8, long), (9, "É é\nÀ à ﬀ 你好  x"), (10, "x\r\ny\n\nz\n")]
