"""The corpus pipeline: toxic texts go, texts of no known language go, one of
each group of near duplicates stays, secrets are masked, the rest is packed.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that
``run`` writes as Parquet and rereads as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  Stages keep rows with null or empty
texts unless they say otherwise, keep repeated rows apart, and accept empty
tables and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlens.llm import language_id, minhash, packing, secrets, tokens, toxicity
from moodlens.llm.common import bucket, table, written


def carried(docs: DataFrame) -> DataFrame:
    """Each row as its text and one column of all others, so that no operator's
    result can clash with them."""
    return docs.select(F.struct(F.lit(1).alias("__"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc"),
                       F.col("text").alias("__body"))


def back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from what :func:`carried` made of them."""
    return df.select(*[F.col("__body").alias(c) if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model predicts as toxic."""
    model = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return back(toxicity.score(carried(docs), model, text="__body").where("predicted = 0"), docs)


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is in no learned language: those without a
    letter, and those unlike every profile."""
    profiles = language_id.learn(docs.where(bucket("doc_id", 4) != 2))
    found = language_id.identify(carried(docs), profiles, text="__body")
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.LEAST_SCORE)), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles,
    similarity 0.8 or more): the one with the smallest id.  Texts without words
    are duplicates of nothing."""
    found = minhash.near_duplicates(docs, n=5)
    again = (F.count("*") > 1) & (F.max("n_shingles") > 0)
    heads = found.groupBy("doc_id", "text_hash").agg(F.max("first").alias("first"), again.alias("again")).where("first")
    heads = written(heads, "pipeline-heads")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    marked, own = docs.withColumn("__hash", text_hash).alias("d"), [F.col(f"`{c}`") for c in docs.columns]

    def of(which: str) -> DataFrame:
        return marked.join(heads.where(which).alias("s"), F.expr("d.__hash = s.text_hash AND d.doc_id <=> s.doc_id"), "left_semi")

    kept = of("NOT again").select(*own)
    if heads.where("again").isEmpty():
        return kept
    # equal rows (same id or none, same text): one stands for them, the others go before the shuffle of each task
    rest = F.to_json(F.struct(F.lit(1).alias("__"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    one = of("again").groupBy("doc_id", "__hash").agg(F.min_by(F.struct(*own), rest).alias("__row"))
    return kept.union(one.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text (``n_chars`` follows); all documents stay."""
    _, network = secrets.scan_table(docs)
    found = secrets.redact(carried(docs), network, text="__body")
    text = F.when(F.col("__body").isNotNull(), F.col("redacted"))
    size = F.when(text.isNotNull(), F.length(text).cast("bigint"))
    new = {"text": text, "n_chars": F.coalesce(size, F.col("__doc.n_chars"))}
    return found.select(*[new.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into training sequences; one row per piece."""
    return packing.pack(docs.select("doc_id", "text"), tokens.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("language_id", language_known),
    ("near_duplicates", one_of_each),
    ("secrets", secrets_masked),
    ("packing", packed),
]

#: The stages train models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
