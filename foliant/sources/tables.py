"""Input tables as DataFrames with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of the input tables, in Spark's DDL.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


#: Tables whose rows are long texts, so that work on them is bound by cores.
_TEXTS = ("documents",)


def table(spark: SparkSession, folder: str, name: str, deal: bool = True) -> DataFrame:
    """A table of a data folder; declared ones are read with their schema, without inference.

    A table of texts that comes in no more splits than there are cores (one small file, say) is dealt out to the
    cores first, after columns are pruned and filters applied, unless ``deal`` is false; a large one is read as it lies.
    """
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    rows = reader.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if deal and name in _TEXTS and rows.rdd.getNumPartitions() <= cores:
        return rows.repartition(cores)
    return rows
