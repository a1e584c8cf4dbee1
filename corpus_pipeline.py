"""A training-corpus pipeline: quality, repeated passages, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next stage's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, linededup, packing, pu, simhash
from foliant.llm.common import cut, free, new_folder, read

#: Columns that line dedup adds.
OWN = ("n_units", "removed_units", "words_left", "runs")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject.

    Null and empty texts are scored like any other. A doc_id with several texts goes only if all of them are
    rejected; rows without doc_id stay. Without usable labels nothing is rejected.
    """
    counted = cut(pu.with_counts(docs))
    scored = pu.score(counted, pu.train(counted, read(spark, sf_dir, "labels")))
    rejected = scored.groupBy("doc_id").agg(F.max("score").alias("best")).where("best < 0.5").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones; only one of which no word is left goes.

    A cut passage stands at an earlier place, which is kept or stands earlier still: so every text is kept once.
    n_chars of a cut document is counted anew. Null and empty texts and rows without doc_id stay as they are.
    """
    aside = dict(zip(OWN, free([*docs.columns, *OWN], *OWN), strict=True))
    done = linededup.dedup_lines(docs.withColumnsRenamed(aside)).where("removed_units = 0 or words_left > 0")
    kept = {c: F.col(aside.get(c, c)) for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("removed_units") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(x.alias(c) for c, x in kept.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: texts that share 0.8 of their five-word shingles.

    Four SimHash fingerprints within 4 bits propose pairs; an exact check tests them and finds what they miss.
    Null and empty texts are copies of each other; rows without doc_id stay.
    """
    return simhash.keep_one(docs, prints=4, budget=4, check=(5, 0.8))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that carry no benchmark text. Null and empty texts carry none; an empty benchmark keeps all."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, filled with lexical neighbours; a null text counts as empty."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", leaks),
    ("packing", sequences),
]

#: The fitted classifier and the packing's retrieval can't be put in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
