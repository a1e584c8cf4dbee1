"""Chunks of documents: greedy packing as folds over a document's own parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE, OVERLAP, SHORT = 1800, 200, 900
_WS = r"[\s\p{Z}]+"
_PIECE = "struct<text:string,start:int>"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{_WS}|{_WS}$", "")


def _push(out: Column, text: Column, start: Column) -> Column:
    return F.when(_strip(text) == "", out).otherwise(F.concat(out, F.array(F.struct(_strip(text).alias("text"), start.cast("int").alias("start")))))


def pack_sentences(text: Column, base: Column, size: int = SIZE, lossy_wrap: bool = False, compat: bool = False) -> Column:
    """Pieces (text, start) of sentences packed while buffer + sentence fit the size (the space between isn't counted).

    A sentence over the size is wrapped without loss, or cut with ``lossy_wrap``. ``compat`` reports the first
    sentence's place for all later pieces of a paragraph.
    """
    sentences = F.split(text, r"(?<=[.!?])\s+")
    whole = lambda s: F.array(F.struct(F.left(s, F.lit(size)).alias("t"), (F.length(s) + 1).alias("step")))
    wrapped = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(size)), lambda i: F.struct(F.substring(s, i + 1, F.lit(size)).alias("t"), F.when(i + size >= F.length(s), F.length(s) - i + 1).otherwise(size).alias("step")))
    parts = F.flatten(F.transform(sentences, lambda s: whole(s) if lossy_wrap else F.when(F.length(s) <= size, whole(s)).otherwise(wrapped(s))))
    empty = F.array().cast(f"array<{_PIECE}>")
    zero = F.struct(F.lit("").alias("buf"), F.lit(0).alias("start"), F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, p: Column) -> Column:
        start = F.when(state["buf"] == "", state["at"]).otherwise(state["start"])
        fits = F.length(state["buf"]) + F.length(p["t"]) <= size
        joined = F.concat(state["buf"], F.when(state["buf"] == "", "").otherwise(" "), p["t"])
        return F.struct(
            F.when(fits, joined).otherwise(p["t"]).alias("buf"), F.when(fits, start).otherwise(start if compat else state["at"]).alias("start"),
            (state["at"] + p["step"]).alias("at"), F.when(fits, state["out"]).otherwise(_push(state["out"], state["buf"], base + start)).alias("out"),
        )

    return F.aggregate(parts, zero, step, lambda state: _push(state["out"], state["buf"], base + state["start"]))


def structural(text: Column, size: int = SIZE) -> Column:
    """Pieces (text, start): paragraphs packed up to the size; one over the size is packed by its sentences."""
    ends = F.split(text, r"(?<=\n)(?=\s*\n)")
    lead = lambda p: F.length(F.regexp_extract(p, r"^\s*\n", 0))
    paragraphs = F.transform(ends, lambda p: F.struct(F.length(p).alias("n"), lead(p).alias("lead"), F.regexp_replace(p, r"^\s*\n|\n$", "").alias("t")))
    empty = F.array().cast(f"array<{_PIECE}>")
    zero = F.struct(F.lit("").alias("buf"), F.lit(0).alias("start"), F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, p: Column) -> Column:
        t, blank = p["t"], _strip(p["t"]) == ""
        here = state["at"] + p["lead"]
        start = F.when(state["buf"] == "", here).otherwise(state["start"])
        fits = F.length(state["buf"]) + F.length(t) <= size
        flushed = _push(state["out"], state["buf"], start)
        small = F.length(t) <= size
        return F.struct(
            F.when(blank, state["buf"]).when(fits, F.concat(state["buf"], F.when(state["buf"] == "", "").otherwise("\n\n"), t)).when(small, t).otherwise("").alias("buf"),
            F.when(blank, state["start"]).when(fits, start).otherwise(here).alias("start"),
            (state["at"] + p["n"]).alias("at"),
            F.when(blank | fits, state["out"]).when(small, flushed).otherwise(F.concat(flushed, pack_sentences(t, here, size))).alias("out"),
        )

    return F.aggregate(paragraphs, zero, step, lambda state: _push(state["out"], state["buf"], state["start"]))


def merge_short(pieces: Column, least: int = SHORT) -> Column:
    """A piece joins the one before if either is under the least size."""
    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        short = (F.length(p["text"]) < least) | (F.length(last["text"]) < least)
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.concat(last["text"], F.lit(" "), p["text"]).alias("text"), last["start"].alias("start"))))
        return F.when(F.size(out) == 0, F.array(p)).otherwise(F.when(short, joined).otherwise(F.concat(out, F.array(p))))

    return F.aggregate(pieces, F.array().cast(f"array<{_PIECE}>"), step)


def explode(docs: DataFrame, pieces: Column) -> DataFrame:
    """(doc_id, chunk_index, text, start) from an expression for a document's pieces."""
    return docs.select("doc_id", pieces.alias("pieces")).select("doc_id", F.posexplode_outer("pieces").alias("chunk_index", "p")).where("p is not null").select("doc_id", "chunk_index", "p.text", "p.start")


def overlap(chunks: DataFrame, size: int = OVERLAP) -> DataFrame:
    """Each chunk with the end of the one before (as it was without overlap)."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("text", F.when(before.isNotNull(), F.concat(F.right(before, F.lit(size)), F.lit(" "), "text")).otherwise(F.col("text")))


def fixed(text: Column, size: int = 512, lap: int = 50) -> Column:
    """Pieces of a stripped text: windows that end at the last full stop or line feed past their half, each beginning
    ``lap`` characters before the last one's end.

    The text is stripped once and cut into blocks, so that a window costs its block and not all text before it.
    """
    block = 16 * size
    blocks = lambda t: F.transform(F.sequence(F.lit(0), F.length(t), F.lit(block)), lambda i: F.substring(t, i + 1, F.lit(block + size)))
    bound = F.transform(F.array(_strip(text)), lambda t: F.struct(F.length(t).alias("n"), blocks(t).alias("blocks")))
    return F.get(F.transform(bound, lambda b: _fixed(b["n"], b["blocks"], size, lap, block)), F.lit(0))


def _fixed(n: Column, blocks: Column, size: int, lap: int, block: int) -> Column:
    """Pieces of a text of n characters from its blocks, each of which goes on for one window."""
    rounds = F.sequence(F.lit(0), F.floor(n / (size // 2 - lap)).cast("int") + 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PIECE}>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        whole = F.substring(F.get(blocks, F.floor(at / block).cast("int")), at % block + 1, F.lit(size))

        def cut_off(window: Column) -> Column:
            back = F.reverse(window)
            last = lambda c: F.when(F.contains(window, F.lit(c)), F.lit(size) - F.locate(c, back)).otherwise(-1)
            return F.struct(window.alias("window"), F.greatest(last("."), last("\n")).alias("stop"))

        def taken(w: Column) -> Column:
            length = F.when((at + size < n) & (w["stop"] > size // 2), w["stop"] + 1).otherwise(F.lit(size))
            piece = F.struct(_strip(F.left(w["window"], length)).alias("text"), at.cast("int").alias("start"))
            return F.struct((at + length - lap).alias("at"), piece.alias("piece"))

        def joined(p: Column) -> Column:
            out = F.when(p["piece"]["text"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(p["piece"])))
            return F.struct(p["at"].alias("at"), out.alias("out"))

        bound = F.transform(F.transform(F.transform(F.array(whole), cut_off), taken), joined)
        return F.when(at < n, F.get(bound, F.lit(0))).otherwise(state)

    return F.aggregate(rounds, zero, step, lambda state: state["out"])


def windows(text: Column, size: int = 6000, least: int = 40) -> Column:
    """Texts of at most ``size`` characters that end, past 70 %, at a blank line or else after a sentence."""
    n = F.length(text)
    floor = int(size * 0.7)
    rounds = F.sequence(F.lit(0), F.floor(n / floor).cast("int") + 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        reach = F.substring(text, at + 1, F.lit(size + 2))
        last = lambda c: F.when(F.contains(reach, F.lit(c)), F.length(reach) - F.locate(c[::-1], F.reverse(reach)) - 1).otherwise(-1)
        paragraph, sentence = last("\n\n"), last(". ")
        end = F.when(at + size >= n, n).when(paragraph > floor, at + paragraph).when(sentence > floor, at + sentence + 1).otherwise(at + size)
        part = _strip(F.substring(text, at + 1, end - at))
        return F.when(at < n, F.struct(end.alias("at"), F.when(F.length(part) >= least, F.concat(state["out"], F.array(part))).otherwise(state["out"]).alias("out"))).otherwise(state)

    return F.aggregate(rounds, zero, step, lambda state: state["out"])


def sample(items: Column, most: int) -> Column:
    """At most ``most`` items, evenly spaced."""
    return F.when(F.size(items) <= most, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, F.floor(i * F.size(items) / most).cast("int"))))


def semantic(chunks: DataFrame, embed: Column | None = None, threshold: float = 0.45, least: int = SHORT) -> DataFrame:
    """Chunks cut where neighbouring sentences differ by more than the threshold, short pieces merged.

    ``embed`` maps the column ``sentence`` to a vector; the default is a hashed bag of words.
    """
    from foliant.functions.hooks import hashed_bag

    s = chunks.select("doc_id", "chunk_index", "start", F.posexplode_outer(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: _strip(x) != "")).alias("k", "sentence"))
    own = Window.partitionBy("doc_id", "chunk_index").orderBy("k")
    vector = s.withColumn("v", embed if embed is not None else hashed_bag(F.col("sentence")))
    cosine = F.aggregate(F.zip_with("v", F.lag("v").over(own), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y)
    every = F.count("*").over(Window.partitionBy("doc_id", "chunk_index"))
    marked = vector.withColumns({"apart": F.coalesce(((1 - cosine) > threshold) & (every >= 4), F.lit(False)).cast("int"), "before": F.coalesce(F.sum(F.length("sentence") + 1).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    grouped = marked.withColumn("piece", F.sum("apart").over(own)).groupBy("doc_id", "chunk_index", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]), " ").alias("text"), F.min(F.col("start") + F.col("before")).cast("int").alias("start"))
    pieces = grouped.groupBy("doc_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text", "start"))), lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"))).alias("p"))
    merged = pieces.select("doc_id", "chunk_index", F.posexplode(merge_short(F.col("p"), least)).alias("piece", "m"))
    return merged.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "piece")).alias("chunk_index"), "m.text", "m.start")
