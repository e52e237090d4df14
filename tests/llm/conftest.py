import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Null, empty, blank, very long, repeated and otherwise odd texts.
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", None, 4), (4, "word " * 30_000, "en", "a", 150_000),
    (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14), (None, "no id at all", "en", "a", 12), (6, "x" * 20_000, None, "b", 20_000),
    (7, "été 中文 \U0001f600 İI  two  spaces\r\n \n \n", "fr", "a", 30), (8, "12345 67890 !!", "en", "a", 14),
]


def frame(spark, rows=None, extra=True):
    """Odd documents, with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD if rows is None else rows, DOCUMENT)
    if not extra:
        return df
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("mine") for c in ("score", "predicted", "row", "length", "label", "__text2", "llr", "ids", "v")})


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"select * from '{SF}/documents.parquet' order by doc_id").fetchall()
