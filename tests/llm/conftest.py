import pytest
from pyspark.sql import types as T


def docs_schema():
    return T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("bucket", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("size", T.StringType()),
    ])


BIG = 2**60 + 1
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps for a long while near the old river bank today"


@pytest.fixture(scope="session")
def odd_rows():
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (BIG, PASSAGE, "en", "b", 10), (BIG, PASSAGE, "en", "b", 10), (4, PASSAGE.upper(), "en", "b", 10),
        (None, PASSAGE + " x", "de", None, 5), (None, "one two", "de", None, 5), (5, "one two", "de", "c", 5), (6, LONG, "fr", "c", 5), (7, "naïve ñandú 日本語 \x00 <|endoftext|>", "es", "c", 5),
        (8, "You stupid idiot. Fine day.", "en", "d", 5), (9, "Released under the MIT License", "en", "d", 5),
    ]
    return [(*r, "x", "y", "z") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, docs_schema()).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], docs_schema())


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def folder(spark, odd, labels, tmp_path_factory):
    """A folder of tables with odd rows."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>a &amp; b</p>"), (3, "u", "<body><article><h1>T</h1><p>one <b>t</b>wo"), (3, "u", "<!-- <p>x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(i % 3), 1.0, float(i % 7)]) for i in range(50)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (120, [1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def bare(spark, none, tmp_path_factory):
    """A folder of empty tables."""
    path = str(tmp_path_factory.mktemp("bare"))
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path
