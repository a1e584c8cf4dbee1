"""Job, chat and quota state: the same rules for batches and, in ``streams``, for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.lineage import cut
from foliant.operators.ordering import following, summed


def backoff_seconds(attempts: Column, base: int = 20, most: int = 300) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2), attempts - 1)).cast("int")


#: Keys of up to so many distinct times are folded in one row; larger ones go by doubling.
FOLDED = 1000


def burst_groups(events: DataFrame, key: str, seconds: int = 120) -> DataFrame:
    """(key, burst, started, n): bursts anchored on their first message; later ones don't extend them.

    Where a burst begins depends on the one before. A key of up to ``FOLDED`` times is folded in order; a larger one's
    bursts are found without gathering it. Messages without a time don't come; a null key is a key like others.
    """
    times = cut(events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us is not null").groupBy(key, "us").agg(F.count("*").alias("n")))
    large = cut(times.groupBy(F.col(key).alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > FOLDED).select("_large"))
    if large.limit(1).count():
        mine = F.col(key).eqNullSafe(F.col("_large"))
        found = _folded(times.join(large, mine, "left_anti"), key, seconds).unionByName(_doubled(cut(times.join(large, mine, "left_semi")), key, seconds))
    else:
        found = _folded(times, key, seconds)
    return found.select(key, "burst", F.timestamp_micros("us").cast("timestamp_ntz").alias("started"), "n")


def _folded(times: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, burst, us, n) of times (key, us, n), a key at a time; each key has few times."""
    listed = times.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("us", "n"))).alias("all"))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["us"].alias("us"), (last["n"] + x["n"]).alias("n"))))
        joins = (F.size(out) > 0) & (x["us"] < last["us"] + seconds * 1_000_000)
        return F.when(joins, grown).otherwise(F.concat(out, F.array(x)))

    bursts = F.aggregate("all", F.array().cast("array<struct<us:bigint,n:bigint>>"), step)
    return listed.select(key, F.posexplode(bursts).alias("burst", "b")).select(key, "burst", "b.us", "b.n")


def _doubled(times: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, burst, us, n) of times (key, us, n) for keys of any size.

    A message that begins a burst is followed by the first one that is ``seconds`` or more later, so each message's
    successor is found by one ordering of messages and of the times they wait for. The beginnings are what a key's
    first message reaches; they are found by doubling: after k rounds 2^k of each key, so a key takes the logarithm of
    its bursts in rounds of joins.
    """
    span = seconds * 1_000_000
    awaited = times.select(key, (F.col("us") + span).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("said"), F.col("us").alias("of"))
    said = times.select(key, F.col("us").alias("at"), F.lit(1).alias("kind"), F.col("us").alias("said"), F.lit(None).cast("long").alias("of"))
    met = following(awaited.unionByName(said), key, "said", "at", "kind").where("of is not null and next is not null")
    jump = cut(met.select(F.col(key).alias("_k"), "of", F.col("next").alias("to")))
    heads = cut(times.groupBy(F.col(key).alias("_k")).agg(F.min("us").alias("of")))
    known = 0
    while (n := heads.count()) > known:
        known = n
        a, b = heads.alias("a"), jump.alias("b")
        ahead = a.join(b, F.col("a._k").eqNullSafe(F.col("b._k")) & (F.col("a.of") == F.col("b.of"))).select("a._k", F.col("b.to").alias("of"))
        heads = cut(heads.unionByName(ahead).distinct())
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(a.join(b, F.col("a._k").eqNullSafe(F.col("b._k")) & (F.col("a.to") == F.col("b.of"))).select("a._k", "a.of", "b.to"))
    begins = heads.select("_k", F.col("of").alias("_us"), F.lit(1).alias("begins"))
    marked = times.join(begins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("us") == F.col("_us")), "left").select(key, "us", "n", "begins")
    placed = summed(marked, key, "begins", "us").withColumn("burst", (F.col("before") + F.coalesce("begins", F.lit(0)) - 1).cast("int"))
    bursts = placed.groupBy(key, "burst").agg(F.min("us").alias("us"), F.sum("n").alias("n"))
    return bursts.select(key, "burst", "us", "n")


def stale(jobs: DataFrame, key: str, now: Column, attempts: str, most: int = 3, silence: int = 150) -> DataFrame:
    """(key, status): a running job without a sign for ``silence`` seconds waits again, or is dead at its last attempt."""
    late = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp")) > silence * 1_000_000
    state = F.when((F.col("status") == "RUNNING") & late, F.when(F.col(attempts) >= most, "DEAD").otherwise("PENDING")).otherwise(F.col("status"))
    return jobs.select(key, state.alias("status"))


def sessions(events: DataFrame, key: str, gap: int = 600) -> DataFrame:
    """(key, started, n): sessions that end with a gap of ``gap`` seconds."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    marked = events.withColumn("fresh", F.coalesce((us - F.lag(us).over(w) >= gap * 1_000_000).cast("int"), F.lit(1)))
    return marked.withColumn("s", F.sum("fresh").over(w)).groupBy(key, "s").agg(F.min("ts").alias("started"), F.count("*").alias("n")).drop("s")
