"""Measures of answers and of paired systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.lineage import cut, shared_folder
from foliant.operators.linking import names_holding, same_names, substring_index
from foliant.operators.ordering import ranked


def token_f1(rows: DataFrame, keys: list[str], answer: Column, gold: Column) -> DataFrame:
    """(keys, f1) from the multisets of both sides' tokens: 1 if both are empty, 0 if one is or none is shared."""
    both = rows.select(*keys, answer.alias("a"), gold.alias("g"))
    sides = both.select(*keys, F.explode(F.concat(F.transform("a", lambda t: F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"), t.alias("t"))), F.transform("g", lambda t: F.struct(F.lit(0).alias("x"), F.lit(1).alias("y"), t.alias("t"))))).alias("s"))
    counts = sides.groupBy(*keys, "s.t").agg(F.sum("s.x").alias("x"), F.sum("s.y").alias("y"))
    common = counts.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("c"))
    na, ng = F.size("a"), F.size("g")
    f1 = F.when((na == 0) & (ng == 0), 1.0).when(F.coalesce("c", F.lit(0)) == 0, 0.0).otherwise(2 * F.col("c") / (na + ng))
    return both.join(common, keys, "left").select(*keys, F.round(f1, 6).alias("f1"))


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact binomial p of discordant pairs; 1 without any. Terms are summed from their logarithms."""
    n, low = only_a + only_b, F.least(only_a, only_b)
    log_half = -0.6931471805599453
    start = F.struct((n * log_half).cast("double").alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] + F.log((n - i) / (i + 1))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0), low.cast("int")), start, step, lambda s: s["sum"])))


def independent_first(items: DataFrame, links: DataFrame) -> DataFrame:
    """(item): the set that taking items by id gives, where a taken one shuts out those it is linked with.

    Rounds: items that are the least of their open neighbourhood are taken, their neighbours go. Every round
    settles at least the least open item of each component; chains of links bound the number of rounds.
    """
    spark = items.sparkSession
    shared_folder(spark)
    both = links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct().checkpoint()
    open_, taken = items.select("item").distinct().checkpoint(), None
    while open_.limit(1).count():
        here = both.join(open_.select(F.col("item").alias("a")), "a", "left_semi").join(open_.select(F.col("item").alias("b")), "b", "left_semi")
        least = here.groupBy("a").agg(F.min("b").alias("near"))
        now = open_.join(least, open_["item"] == least["a"], "left").where("near is null or item < near").select("item").checkpoint()
        gone = both.join(now.select(F.col("item").alias("a")), "a", "left_semi").select(F.col("b").alias("item")).distinct()
        open_ = open_.join(now, "item", "left_anti").join(gone, "item", "left_anti").checkpoint()
        taken = now if taken is None else taken.unionByName(now)
    return taken if taken is not None else items.select("item").limit(0)


def graph_recall(turns: DataFrame) -> DataFrame:
    """(conv_id, entities, found, triples, triples_found) of turns (conv_id, asked, l: names in order).

    Names of asked turns are wanted, those of the others are found; a pair of consecutive names is a relation, and one
    is found if both its ends are, next to each other in either direction.
    """
    names = turns.select("conv_id", "asked", F.explode_outer("l").alias("name")).where("name is not null").distinct()
    ahead = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(F.get("l", i - 1).alias("a"), F.get("l", i).alias("b")))
    chains = cut(turns.where(F.size("l") > 1).select("conv_id", "asked", F.explode(ahead).alias("t")).select("conv_id", "asked", "t.a", "t.b").distinct())
    wanted, found = names.where("asked").select("conv_id", "name"), names.where("not asked").select("conv_id", "name")
    same = cut(same_names(wanted, found, "conv_id"))
    hits = same.select("conv_id", "name").distinct().withColumn("hit", F.lit(1))
    entities = wanted.join(hits, ["conv_id", "name"], "left").groupBy("conv_id").agg(F.count("*").alias("entities"), F.count("hit").alias("found"))
    triples = chains.where("asked").select("conv_id", "a", "b")
    ends = [same.select("conv_id", F.col("name").alias(e), F.col("other").alias(f"{e}_other")) for e in "ab"]
    met = triples.join(ends[0], ["conv_id", "a"]).join(ends[1], ["conv_id", "b"])
    told = chains.where("not asked")
    either = told.select("conv_id", F.col("a").alias("a_other"), F.col("b").alias("b_other")).union(told.select("conv_id", "b", "a")).distinct()
    seen = met.join(either, ["conv_id", "a_other", "b_other"], "left_semi").select("conv_id", "a", "b").distinct().withColumn("hit", F.lit(1))
    counts = triples.join(seen, ["conv_id", "a", "b"], "left").groupBy("conv_id").agg(F.count("*").alias("triples"), F.count("hit").alias("triples_found"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("triples", "triples_found")]
    return entities.join(counts, "conv_id", "left").select("conv_id", "entities", "found", *zero)


def leak_free(items: DataFrame, share: float) -> DataFrame:
    """(item, place): a share of the items (item, text, answer), in order, so that no answer stands in the texts that it is asked of.

    Chosen items take places in order of their ids and go to two volumes by turns; an answer is asked of the other
    volume and leaks if it stands there, whatever the case. Leaking items are dropped for good and the next ones move
    up, which changes the volumes; so rounds go on until one drops nothing. Each drops at least one item, and in
    practice a part of what is left. Answers meet texts by their rarest piece of three characters. An empty answer
    stands in no text; items without text or answer don't leak.
    """
    rows = cut(items.select("item", "text", F.nullif("answer", F.lit("")).alias("answer")))
    most = -int(-rows.count() * share // 1)
    left = rows
    while True:
        placed = ranked(left.withColumn("_all", F.lit(0)), "_all", "item").where(F.col("place") < most)
        chosen = cut(placed.select("item", "text", "answer", "place"))
        texts = chosen.where("text is not null")
        index = substring_index(texts.select(F.col("text").alias("name")))
        held = names_holding(chosen.where("answer is not null").select(F.col("answer").alias("part")), index)
        sides = texts.select(F.col("text").alias("name"), (F.col("place") % 2).alias("volume")).distinct()
        there = held.join(sides, "name").select(F.col("part").alias("answer"), (1 - F.col("volume")).alias("asked")).distinct()
        asked = chosen.withColumn("asked", F.col("place") % 2)
        leaking = cut(asked.join(there, ["answer", "asked"], "left_semi").select("item"))
        if not leaking.limit(1).count():
            return chosen.select("item", "place")
        left = cut(left.join(leaking, "item", "left_anti"))
