"""The corpus pipeline: documents -> language ID -> n-gram Jaccard join -> secret scan -> source mix -> BPE.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; ``run``
writes each as Parquet in the shared folder and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsward.llm import bpe, langid, mixing, ngram_join, secrets
from opsward.llm.common import neutral, read, small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in no learnt language (too few of their n-grams are features of the
    model, see ``langid.Model``); a missing language is filled in. Without any labelled document only those without a
    letter go. Further columns of any name stay as they are."""
    small_batches(spark)
    model = langid.fit(docs)
    if not model.classes:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    plain, back = neutral(docs, ("doc_id", "text", "lang"))
    got = langid.predict(plain, model, names=("__lang", "__score", "__known")).where((F.col("__lang") != "und") & (F.col("__known") >= model.least_known))
    return back(got.withColumn("lang", F.coalesce("lang", "__lang")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of rows with equal ids one in a group, so
    an id with different texts keeps each that no other stands for. Documents without words or without an id stay.
    Further columns of any name stay as they are."""
    small_batches(spark)
    docs, back = neutral(docs, ("doc_id", "text"))
    rows, key = ngram_join.grouped(docs)
    low = rows.where("group is not null").groupBy("group").agg(F.min("doc").alias("low"))
    got = stored(rows.join(low, "group", "left").select("doc", "class", "group", (F.col("low") < F.col("doc")).alias("copy")), "pipeline-components")
    ids = got.where("doc is not null").groupBy(F.col("doc").alias("id")).agg(
        F.count("*").alias("rows"), F.coalesce(F.max("copy"), F.lit(False)).alias("copy"))
    ids = stored(ids.where("copy or rows > 1"), "pipeline-ids")
    out = docs.join(ngram_join.hinted(ids.select("id")), F.col("doc_id") == F.col("id"), "left_anti")
    again = ids.where("rows > 1")
    if again.isEmpty():
        return back(out)
    # ids of several rows: each row by its text
    texts = ngram_join.classed(docs.join(ngram_join.hinted(again.select("id")), F.col("doc_id") == F.col("id"), "left_semi"), "__class", key)
    fate = got.join(again, F.col("doc") == F.col("id"), "left_semi").select("doc", F.col("class").alias("__of"), "group", F.col("copy").alias("__copy")).distinct()
    texts = texts.join(fate, (F.col("doc_id") == F.col("doc")) & F.col("__class").eqNullSafe(F.col("__of"))).where(~F.coalesce("__copy", F.lit(False)))
    first = Window.partitionBy("doc_id", "group").orderBy(F.xxhash64("text"), "text")
    once = texts.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return back(out.unionByName(once.select(*docs.columns)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; no document goes."""
    small_batches(spark)
    clean = secrets.redact(docs, secrets.fit_field(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, dealt to its shards and shuffled there. Further columns of any name
    stay as they are."""
    small_batches(spark)
    plain, back = neutral(docs, ("doc_id", "text", "source"))
    return back(mixing.Mix(plain).rows(plain, names=("__to", "__order")))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe", bpe_round_trip),
]

# Language ID, secret scan and BPE can't be said in SQL; tests/llm has a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
