"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
Rows go when the toxicity model rejects them, when another row of their near-duplicate group stays, or when they hold a
benchmark item. Line dedup changes texts (and n_chars) and keeps every row. Stages write what must survive a lost
executor to the shared folder; run() hands each stage's frame to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, decontamination, line_dedup, near_dedup, toxicity
from weftline.llm.queries import PATTERN, RANKS
from weftline.llm.shared import fresh, materialise, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below one half; the model is fitted on labelled rows of docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the content-defined chunks of lines and the passages that stand somewhere before; n_chars follows the text."""
    found = line_dedup.dedup_passages(docs, divisor=line_dedup.DIVISOR)
    length = F.when(F.col(found.columns[-1])["removed_units"] > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, by five words and a similarity of 0.8.

    Rows without an id get one from their text, above all ids that tables have. Rows that share an id are one document:
    of those that stay, the one of the least text hash does.
    """
    made = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    keyed = docs.withColumn(fresh("row_id", docs.columns), F.coalesce(F.col("doc_id").cast("long"), made))
    key = keyed.columns[-1]
    found = materialise(near_dedup.groups(keyed, key=key, width=5, percent=80).groupBy(key).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "near-duplicates")
    once = keyed.join(found.filter("not kept").select(key), key, "left_anti")
    again = found.filter("kept").select(key)
    if not again.limit(1).count():
        return once.select(*docs.columns)
    row = F.min_by(F.struct(*docs.columns), F.xxhash64(F.coalesce("text", F.lit(""))))
    first = once.join(again, key, "left_semi").groupBy(key).agg(row.alias("row")).select("row.*")
    return once.join(again, key, "left_anti").select(*docs.columns).unionByName(first)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    found = materialise(decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id"), "text_hash").distinct(), "leaks").alias("leaks")
    same = F.col("docs.doc_id").eqNullSafe(F.col("leaks.id")) & (F.xxhash64(F.coalesce("docs.text", F.lit(""))) == F.col("leaks.text_hash"))
    return docs.alias("docs").join(found, same, "left_anti")


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of the ids and of the bytes decoded from them."""
    return byte_bpe.digests(docs, RANKS, PATTERN)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", byte_bpe_stage),
]
#: The toxicity model and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
