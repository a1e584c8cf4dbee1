"""Repeated runs of lines: winnowed fingerprints, joined and extended. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut, free, sized

#: A unit is a line, or a sentence inside one. Group 1 is its text; white space after it belongs to the unit, so
#: blank lines are no units and don't set two copies apart. Possessive repeats keep the match linear.
_UNIT = (
    r"(?!\z)(?:\A[ \t\r\n]++)?+"
    r"([^\n\r.!?…]*+(?:[.!?…]++(?! )[^\n\r.!?…]*+)*+(?:[.!?…]++(?= ))?+)"
    r"(?: [ \t\r\n]*+|[\n\r][ \t\r\n]*+|\z)"
)
_WHITE = " \t\r\n"
_KEY = ("doc_id", "text_hash")


def units(text: Column) -> Column:
    """The units of a text with the white space around them; joined, they give the text back."""
    return F.regexp_extract_all(text, F.lit(_UNIT), 0)


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, h, w): hash and number of words of every unit, one row for each text of a doc_id."""
    known = docs.where("doc_id is not null and text is not null")
    plain = F.regexp_extract_all(F.col("text"), F.lit(_UNIT), 1)
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), plain.alias("u"))

    def digest(unit: Column) -> Column:
        return F.struct(F.xxhash64(F.rtrim(unit)).alias("h"), F.size(F.split(unit, " ")).alias("w"))

    return rows.select(*_KEY, F.transform("u", digest).alias("u")).select(*_KEY, "u.h", "u.w").dropDuplicates([*_KEY])


def winnow(digests: DataFrame, gram: int, window: int) -> DataFrame:
    """(doc_id, text_hash, n, g, pos, before): selected fingerprints of a text of n units.

    The gram at a unit is the hash of the units from there on, up to ``gram`` words at least. Of the grams that
    start within ``window`` words, the least is selected. Every run of gram + window - 1 words that two texts
    share holds one of these windows whole, so both select the same gram of it. ``before`` is the last place of
    the same fingerprint in its text.
    """
    each = digests.repartition(*_KEY).select(*_KEY, F.size("h").alias("n"), F.posexplode(F.arrays_zip("h", "w")).alias("pos", "u"))
    own = Window.partitionBy(*_KEY)
    at = F.sum("u.w").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("u.w")
    placed = each.select(*_KEY, "n", "pos", "u.h", "u.w", at.alias("at"))
    span = own.orderBy("at").rangeBetween(0, gram - 1)
    end = F.max(F.col("at") + F.col("w")).over(span)
    grams = placed.select(*_KEY, "n", "pos", "at", end.alias("end"), F.xxhash64(F.collect_list("h").over(span)).alias("g"))
    grams = grams.where(F.col("end") - F.col("at") >= gram)
    least = F.min(F.struct("g", (-F.col("at")).alias("minus"), "pos")).over(own.orderBy("at").rangeBetween(0, window - 1))
    chosen = grams.select(*_KEY, "n", least.alias("m")).select(*_KEY, "n", "m.g", "m.pos").distinct()
    return chosen.withColumn("before", F.lag("pos").over(Window.partitionBy(*_KEY, "g").orderBy("pos")))


def _candidates(marks: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, source, source_hash, shift): texts to compare with earlier ones, and by which shift.

    A fingerprint's first place in each text meets its first place in the corpus; a further place in the same
    text meets the place before.
    """
    opening = marks.where("before is null")
    first = opening.groupBy("g").agg(F.min(F.struct(*_KEY, "pos")).alias("f"), F.count("*").alias("many")).where("many > 1")
    first = first.select("g", F.col("f.doc_id").alias("source"), F.col("f.text_hash").alias("source_hash"), F.col("f.pos").alias("source_pos"))
    across = opening.join(first, "g").where("doc_id != source or text_hash != source_hash")
    across = across.select(*_KEY, "n", "source", "source_hash", (F.col("source_pos") - F.col("pos")).alias("shift"))
    itself = (F.col("doc_id").alias("source"), F.col("text_hash").alias("source_hash"))
    within = marks.where("before is not null").select(*_KEY, "n", *itself, (F.col("before") - F.col("pos")).alias("shift"))
    return across.unionByName(within).distinct()


def repeated_runs(docs: DataFrame, gram: int = 30, window: int = 20) -> DataFrame:
    """(doc_id, text_hash, n_units, runs): for each text with later repeats, its runs (lo, hi, source) of units
    that stand earlier, in document ``source`` (order: doc_id, then hash of the text, then place).

    Fingerprints meet by their hash. Every occurrence is compared with the first one only, so a passage that a
    third of the corpus shares gives as many candidates as it has copies, not their square; since a gram is
    itself a repeat of ``gram`` words, the first occurrence is always a true one. Each candidate is extended to
    both sides over the whole overlap, and kept where a run of equal units has ``gram`` words or more. Of the
    source only the part that overlaps goes along, so a row is never larger than the text that it is about,
    however long the source is.
    """
    digests = cut(_digests(docs))
    marks = cut(winnow(digests, gram, window))
    pairs = sized(cut(_candidates(marks)), 400_000)
    theirs = digests.select(F.col("doc_id").alias("source"), F.col("text_hash").alias("source_hash"), F.col("h").alias("source_h"))
    lo = F.greatest(F.lit(0), -F.col("shift"))
    count = F.greatest(F.least(F.col("n"), F.size("source_h") - F.col("shift")) - lo, F.lit(0))
    overlap = F.slice("source_h", lo + F.col("shift") + 1, count)
    met = pairs.join(theirs, ["source", "source_hash"]).select(*_KEY, "source", lo.alias("lo"), overlap.alias("theirs"))
    both = sized(cut(met), 2_000).join(digests, [*_KEY])
    n_both = F.size("theirs")
    same = lambda i: (i >= 0) & (i < n_both) & (F.get("h", F.col("lo") + i) == F.get("theirs", i))
    at = F.when(n_both > 0, F.sequence(F.lit(0), n_both - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(at, lambda i: same(i) & ~same(i - 1))
    ends = F.filter(at, lambda i: same(i) & ~same(i + 1))
    zipped = F.arrays_zip(begins.alias("lo"), ends.alias("hi"))
    runs = F.transform(zipped, lambda r: F.struct((r["lo"] + F.col("lo")).alias("lo"), (r["hi"] + F.col("lo")).alias("hi"), F.col("source").alias("source")))
    words = lambda r: F.aggregate(F.slice("w", r["lo"] + 1, r["hi"] - r["lo"] + 1), F.lit(0), lambda a, w: a + w)
    found = both.select(*_KEY, F.size("h").alias("n_units"), F.filter(runs, lambda r: words(r) >= gram).alias("runs")).where(F.size("runs") > 0)
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs"))))
    return found.groupBy(*_KEY).agg(F.first("n_units").alias("n_units"), merged.alias("runs"))


def dedup_lines(docs: DataFrame, gram: int = 30, window: int = 20) -> DataFrame:
    """docs with later repeated runs cut out of ``text``, and the columns n_units, removed_units, words_left, runs.

    Of a passage that several documents (or places) share, the occurrence with the least (doc_id, hash of the
    text, place) stays. Runs of gram + window - 1 words or more are always found, whatever blank lines stand
    between their lines; shorter ones from ``gram`` words on where a fingerprint falls into them. Where parts of a
    run stand in still earlier texts, it is compared with those, and up to a window of words may stay at each end
    of it. Runs of fewer
    than ``gram`` words stay, however often they repeat: a short line is no evidence of copying. Words are
    counted by the spaces between them.

    removed_units is 0 where nothing is cut, runs is empty, and n_units and words_left are null there. Null
    texts stay null, empty ones empty; rows without doc_id stay as they are. Rows that share a doc_id and a text
    are one document; different texts under one id are documents of their own. All other columns stay; names of
    the four columns above, if docs has them, are replaced.
    """
    own = ["n_units", "removed_units", "words_left", "runs"]
    columns = [c for c in docs.columns if c not in own]
    own_id, own_hash, own_runs, own_units, own_left = free(columns, "own_id", "own_hash", "own_runs", "own_units", "own_left")
    renamed = repeated_runs(docs, gram, window).toDF(own_id, own_hash, own_units, own_runs)
    found = sized(cut(renamed), 200_000)
    joined = docs.select(*columns).join(found, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash)), "left")
    kept = F.filter(units(F.col("text")), lambda u, i: ~F.exists(own_runs, lambda r: (i >= r["lo"]) & (i <= r["hi"])))
    hit = F.col(own_runs).isNotNull()
    marked = joined.withColumn(own_left, F.when(hit, kept))
    left = F.array_join(own_left, "")
    bare = F.btrim(left, F.lit(_WHITE))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t\r\n]+")))
    out = {c: F.col(c) for c in columns} | {"text": F.when(hit, left).otherwise(F.col("text"))}
    none = F.array().cast("array<struct<lo:int,hi:int,source:bigint>>")
    return marked.select(
        *(x.alias(c) for c, x in out.items()),
        F.col(own_units).alias("n_units"),
        F.when(hit, F.col(own_units) - F.size(own_left)).otherwise(0).alias("removed_units"),
        F.when(hit, words).alias("words_left"),
        F.coalesce(own_runs, none).alias("runs"),
    )
