"""Benchmark decontamination by spaced seeds. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut

#: Fixed masks over tokens, by the least length of the items that they serve: only positions with a 1 are hashed.
#: Masks of items under 8 tokens hit wherever one token counts as matched; those of 8 to 16 tokens hit for every
#: choice of substitutions that leaves 0.6 matched (the tests enumerate both); longer items have more chances.
MASKS = {
    1: ("111", "1011", "1101", "10101"),
    8: ("1111", "10111", "11101", "10000111"),
    25: ("111011", "11000111"),
}
_WORD = r"[\p{L}\p{N}]+"
_DOC = ("doc_id", "text_hash")


def _tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text.cast("string")), F.lit(_WORD), 0), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, tokens: str, masks: list[str]) -> DataFrame:
    """rows with one row for each place of the tokens and each mask that fits there, as (place, seed)."""
    at = rows.select("*", F.posexplode_outer(tokens).alias("place", "word")).drop("word")

    def seed(mask: str) -> Column:
        kept = (F.get(tokens, F.col("place") + k) for k, bit in enumerate(mask) if bit == "1")
        return F.when(F.col("place") + len(mask) <= F.size(tokens), F.xxhash64(F.lit(int(mask, 2)), *kept))

    hashed = at.withColumn("hashes", F.array(*map(seed, masks)))
    return hashed.select(*at.columns, F.explode_outer("hashes").alias("seed")).where("seed is not null")


def _same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["own_id"]) & left["text_hash"].eqNullSafe(right["own_hash"])


def _matched(compared: DataFrame) -> DataFrame:
    """compared with ``at``, the places of the item's tokens that agree with the document's at this shift, as do two others of the five around."""
    equal = F.transform("item", lambda t, i: F.get("part", i + F.least(F.col("shift"), F.lit(0))).eqNullSafe(t).cast("int"))
    aligned = compared.withColumn("equal", equal)
    places = F.sequence(F.lit(0), F.size("item") - 1)

    def solid(i: Column) -> Column:
        around = sum((F.coalesce(F.get("equal", i + d), F.lit(0)) for d in (-2, -1, 1, 2)), F.get("equal", i))
        return (F.get("equal", i) == 1) & (around >= 3)

    return aligned.withColumn("at", F.filter(places, solid)).where(F.size("at") > 0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.6, min_tokens: int = 5, masks: dict[int, tuple[str, ...]] = MASKS, max_seeds: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, item_tokens, coverage): documents that carry a benchmark text.

    Seeds of both sides meet by hash. A hit fixes a shift between document and item; around it, the item's
    tokens are compared one by one, so substitutions cost only themselves. A token counts as matched if it
    agrees and at least three of the five around it do; matches of shifts that lie within an item's length of each
    other (after insertions) add up, those of places over two lengths apart don't.
    A document leaks where ``min_coverage`` of the item's tokens are matched.

    Tokens are runs of letters and digits, lower-cased. ``masks`` gives the masks for items from a length on: shorter
    items have lighter masks. Items of fewer than ``min_tokens`` tokens say too little and never match (of fewer than
    three, at any setting). The benchmark's seeds are counted and broadcast up to ``max_seeds``; beyond, the seeds are
    joined by a shuffle and the documents that were hit are read again. A document that repeats an item's tokens is
    compared once for each shift.
    """
    given = benchmark.where("item_id is not null and text is not null")
    items = given.select(F.col("item_id").cast("long").alias("item_id"), _tokens(F.col("text")).alias("item"))
    items = cut(items.where(F.size("item") >= min_tokens).distinct())
    classes = list(zip(sorted(masks), [*sorted(masks)[1:], 1 << 31], strict=True))
    within = [F.size("item").between(low, high - 1) for low, high in classes]
    counts = items.agg(*(F.count_if(c) for c in within)).first()
    used = [k for k, n in enumerate(counts) if n] or [0]
    parts = [_seeds(items.where(within[k]).withColumn("n_item", F.size("item")), "item", list(masks[classes[k][0]])) for k in used]
    seeds = reduce(DataFrame.unionByName, parts).select("item_id", "n_item", F.col("place").alias("item_pos"), "seed")
    seeds = cut(seeds)
    near = seeds.count() <= max_seeds

    text = F.col("text")
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), _tokens(text).alias("tokens"))
    places = _seeds(tokens, "tokens", [m for k in used for m in masks[classes[k][0]]])
    shift = F.col("place") - F.col("item_pos")
    first = F.greatest(F.col("shift"), F.lit(0))
    length = F.least(F.col("n_item") + F.least(F.col("shift"), F.lit(0)), F.size("tokens") - first)
    part = F.slice("tokens", first + 1, F.greatest(length, F.lit(0)))
    if near:
        hits = places.join(F.broadcast(seeds), "seed").withColumn("shift", shift)
    else:
        bare = places.select(*_DOC, "place", "seed").join(seeds, "seed").select(*_DOC, "item_id", "n_item", shift.alias("shift")).distinct()
        again = tokens.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
        hits = bare.join(again, _same_doc(bare, again))
    hits = hits.select(*_DOC, "item_id", "shift", part.alias("part")).dropDuplicates([*_DOC, "item_id", "shift"])
    # Each item has a seed of its own, so where the seeds may be broadcast, the items may.
    compared = _matched(hits.join(F.broadcast(items) if near else items, "item_id"))
    stretch = F.floor(F.col("shift") / F.size("item"))
    stretches = compared.select(*_DOC, "item_id", F.size("item").alias("item_tokens"), "at", F.array(stretch, stretch + 1).alias("both"))
    dealt = stretches.select(*_DOC, "item_id", "item_tokens", "at", F.explode_outer("both").alias("stretch"))
    together = F.size(F.array_distinct(F.flatten(F.collect_list("at"))))
    found = dealt.groupBy(*_DOC, "item_id", "item_tokens", "stretch").agg(together.alias("matched"))
    best = found.where(F.col("matched") >= min_coverage * F.col("item_tokens")).groupBy(*_DOC, "item_id", "item_tokens").agg(F.max("matched").alias("matched"))
    return best.select(*_DOC, "item_id", "matched", "item_tokens", (F.col("matched") / F.col("item_tokens")).alias("coverage"))


def verdicts(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, contaminated, n_items, items) for every row of docs (doc_id, text); items are the ids, ascending.

    Null and empty texts are clean; repeated rows and rows without doc_id are rows of their own and get the
    verdict of their text. An empty benchmark leaves all documents clean. Other columns are ignored.
    """
    found = find_leaks(docs, benchmark, **settings).groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(F.array_sort(F.collect_set("item_id")).alias("own_items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(cut(found), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
    items = F.coalesce("own_items", F.array().cast("array<bigint>"))
    return joined.select("doc_id", F.col("own_items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs that carry no benchmark text, with all their columns."""
    found = cut(find_leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).distinct())
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["own_id"]) & (F.xxhash64(docs["text"]) == found["own_hash"]), "left_anti")
