"""Files, HTML, pages and dialogues into text tables, and results out of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.operators.lineage import shared_folder

PAGE = 3000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; only a session without one gets a local folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# What a tag puts in place of itself, and the named entities that are known. All other tags put nothing.
TAGS = {"br": "\n"} | {f"/{t}": "\n\n" for t in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "section", "tr")}
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _mapped(text: Column, pieces: str, put: Callable[[Column], Column]) -> Column:
    """The text cut into pieces by a pattern that covers it, each as ``put`` has it."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pieces), 0), put), "")


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _tag(piece: Column) -> Column:
    """A tag by its class; scripts and styles come as one piece with what they hold, which goes with them."""
    name = F.lower(F.regexp_extract(piece, "^<(/?[A-Za-z0-9]+)", 1))
    return F.when(piece.rlike("(?s)^<.+>$"), F.coalesce(F.try_element_at(_table(TAGS), name), F.lit(""))).otherwise(piece)


def _entity(piece: Column) -> Column:
    """A named entity from the table, a numbered one as the character of that number; what is neither stays."""
    digits = F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1)
    hexes = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]{1,6});$", 1)
    number = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
    legal = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    character = F.when(legal, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    return F.coalesce(F.try_element_at(_table(ENTITIES), piece), character, piece)


def _blank(piece: Column) -> Column:
    """A run of blanks and line feeds: a blank, or one or two line feeds."""
    breaks = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
    return F.when(~piece.rlike("^[ \\t\\n]"), piece).when(breaks == 0, " ").when(breaks == 1, "\n").otherwise("\n\n")


def html_to_text(x: Column) -> Column:
    """The text of a page's body, or of all of it if it has none: three passes, over tags, entities and white space.

    Each pass cuts the text once into the pieces that it is about and those between, and looks up what stands for them.
    """
    body = F.coalesce(F.nullif(F.regexp_extract(x, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), x)
    plain = _mapped(body, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]+>|[^<]+|<", _tag)
    decoded = _mapped(plain, r"&#?[A-Za-z0-9]+;|[^&]+|&", _entity)
    return strip(_mapped(decoded, r"[ \t\n]+|[^ \t\n]+", _blank))


def page_boundaries(text: Column, size: int = PAGE) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int") - 1), lambda i: i * size)


def page_slices(text: Column, size: int = PAGE) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length(text)) - 1, F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def offset_to_page(place: Column, bounds: Column) -> Column:
    """The 1-based page of an offset: the last boundary that isn't behind it; 1 without boundaries."""
    return F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b <= place)))


def status(text: Column) -> tuple[Column, Column]:
    """READY with any text, else FAILED; and whether so little text was found that it needs OCR."""
    return F.when(F.length(F.trim(text)) > 0, "READY").otherwise("FAILED").alias("status"), (F.length(F.trim(text)) < 20).alias("needs_ocr")


def decode_files(files: DataFrame) -> DataFrame:
    """Files (path, content) with kind, text, status and why: read by their extension, or FAILED with the reason.

    The kind is the file's extension, or that of a folder ``format=...`` which it lies in, as Spark writes them. HTML is
    turned into text, text formats are taken as they are, known containers that need a decoder of their own and
    anything with NUL bytes are binary, and bytes that aren't UTF-8 are told apart from empty files.
    """
    folder = F.regexp_extract("path", r"/format=([A-Za-z0-9]+)/[^/]*$", 1)
    extension = F.lower(F.coalesce(F.nullif(folder, F.lit("")), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    kind = F.when(extension.isin("html", "htm", "xhtml"), "html").when(extension.isin("pdf", "docx", "epub", "zip"), "container").otherwise("text")
    known = files.withColumns({"kind": kind, "plain": F.try_validate_utf8(F.col("content").cast("string"))})
    reason = (
        F.when(F.col("content").isNull() | (F.octet_length("content") == 0), "empty")
        .when(F.col("kind") == "container", "no decoder for this kind")
        .when(F.expr("position(X'00' in content)") > 0, "binary")
        .when(F.col("plain").isNull(), "not UTF-8")
    )
    done = known.withColumn("why", reason).withColumn("text", F.when(F.col("why").isNull(), F.when(F.col("kind") == "html", html_to_text(F.col("plain"))).otherwise(F.col("plain"))))
    failed = F.col("why").isNotNull() | (strip(F.col("text")) == "")
    named = done.withColumns({"status": F.when(failed, "FAILED").otherwise("READY"), "why": F.when(failed, F.coalesce("why", F.lit("no text")))})
    return named.drop("content", "plain")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path as (path, length, kind, text, status, why); Spark's reader passes over files of no bytes."""
    return decode_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content"))


def write_files(rows: DataFrame, path: str) -> None:
    """One file for each row (format, content): its bytes and a line feed, below a folder ``format=...``."""
    lines = rows.select("format", F.col("content").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).partitionBy("format").text(path)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV (conv_id, turns) whose turns are a JSON array with line feeds."""
    raw = spark.read.schema("conv_id long, turns string").option("multiLine", True).option("escape", '"').csv(path)
    return raw.withColumn("turns", F.from_json("turns", "array<struct<turn:long,role:string,text:string>>"))


def read_json_dataset(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The items of JSON arrays: one array in each file, or in each line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_result(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def replace_chunks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Chunks of docs (doc_id, source, text), written by source; only the folders that a delivery holds are replaced."""
    from foliant.operators import chunking as C

    spark = docs.sparkSession
    out = path or scratch(spark, "chunks")
    pieces = docs.select("doc_id", "source", C.structural(F.col("text")).alias("p")).select("doc_id", "source", F.posexplode_outer("p").alias("chunk_index", "p")).where("p is not null").select("doc_id", "source", "chunk_index", "p.text", "p.start")
    first = pieces.withColumn("text", F.when(F.col("source") == "src1", F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    for rows in (first, pieces.where("source = 'src1'")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(out)
    return spark.read.parquet(out)
