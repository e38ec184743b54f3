"""From raw documents to packed sequences: five stages, each a table that the next one reads.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import line_dedup, minhash, mixing, packing, quality_model
from siltstone.llm._common import Scratch, small

#: Documents scored below this are rejected.
MIN_QUALITY = 0.3


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on the labelled rows of ``docs``: documents that score under ``MIN_QUALITY`` go.

    Each row is judged by its text alone, whatever its id (null included) and however often it stands; null and empty texts are
    scored too. Without labels of both classes the model is as initialised. An empty table gives no rows.
    """
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.score(docs, model, out="__score")
    return scored.where(F.col("__score") >= MIN_QUALITY).drop("__score")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup by source: boilerplate lines go, ``n_chars`` follows the text. All rows stay, nulls as they are."""
    return _with_texts(docs, line_dedup.drop_boilerplate_lines(docs).drop("n_lines", "n_dropped"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (five-word shingles, similarity 0.8): of each component one document of the smallest id stays.

    Documents without words stay. Rows that repeat an id and are linked are one document: one row stays (of several texts, the one of the
    smallest hash). Rows without an id are linked by equal sets. An empty table gives no rows.
    """
    found = Scratch(spark, "near-dedup").save(minhash.near_duplicates(docs), "found")
    rows = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_key").alias("least"))
    again = rows.where((F.col("n") > 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("r_id"), "least")
    spare = found.join(again, (F.col("doc_id") == F.col("r_id")) & (F.col("n_shingles") > 0)).where(F.col("text_key") != F.col("least"))
    gone = found.where(~F.col("kept")).unionByName(spare.select(*found.columns)).select("doc_id", "text_key").distinct()
    twice = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_key").count().where("count > 1").drop("count")

    def rows_of(keys: DataFrame, how: str, of: DataFrame) -> DataFrame:
        keys = Scratch(spark, "near-dedup").save(keys.toDF("__id", "__key"), "keys")
        keys = small(keys, keys.count())
        return of.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), how)

    left = rows_of(gone, "left_anti", docs)
    if not twice.isEmpty():
        once = rows_of(twice, "left_semi", left).dropDuplicates(["doc_id", "text"])
        left = rows_of(twice, "left_anti", left).unionByName(once)
    return left.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: each document stands as many times as the mix takes it.

    Rows that repeat an id stand as often as the one of them that is taken most; rows without an id are one id; empty documents go, as
    a mix of words takes none of them. An empty table gives no rows. The numbers of copies are broadcast up to
    a checked size, beyond it joined by shuffle.
    """
    copies = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    copies = Scratch(spark, "mix").save(copies.where(F.col("__copies") > 0), "copies")
    rows = docs.join(small(copies, copies.count()), F.col("doc_id").eqNullSafe(F.col("__id")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Harmonic packing into sequences of 4096 ids. Every row is packed, an empty one as its end; an empty table gives no rows."""
    return packing.pack(docs, packing.default_tokenizer())


def _with_texts(docs: DataFrame, changed: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))
    return changed.select(docs.columns)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, the components, the mix and the tokeniser have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
