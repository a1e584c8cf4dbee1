"""Queries of job, chat and quota state, as batches (checked by SQL) and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.plans.chunk_queries import _CH, _SHOW, _show
from foliant.plans.registry import query
from foliant.sources import ingest
from foliant.sources.tables import SCHEMAS, table
from foliant.streaming import jobs as J
from foliant.streaming import streams as S

_K = "json_extract(props, '$.k')::int"


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


_BURSTS = """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events), b as (select user_id, ts, k, ts as started, 0 as burst from e where k = 1
union all select e.user_id, e.ts, e.k, case when e.ts < b.started + interval 120 second then b.started else e.ts end, case when e.ts < b.started + interval 120 second then b.burst else b.burst + 1 end from b join e on e.user_id = b.user_id and e.k = b.k + 1)
"""
_SESSIONS = """with m as (select user_id, ts, case when ts - lag(ts) over w >= interval 600 second then 1 when lag(ts) over w is null then 1 else 0 end as f, event_id from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(f) over (partition by user_id order by ts, event_id) as s from m) select user_id, min(ts) as started, count(*) as n from s group by user_id, s"""


@query(_BURSTS + "select user_id, burst, started, count(*) as n from b group by all")
def chat_burst_merge(spark: SparkSession, d: str) -> DataFrame:
    return J.burst_groups(table(spark, d, "events"), "user_id")


@query(_SESSIONS)
def chat_session_window(spark: SparkSession, d: str) -> DataFrame:
    return J.sessions(table(spark, d, "events"), "user_id")


_STALE = f"""with j as (select {_K} as job, arg_max(event_type, (ts, event_id)) as last, max(ts) as seen, count(*) filter (event_type = 'click') as attempts from events group by 1), n as (select max(ts) as now from events)
select job, case when last = 'click' and now - seen > interval 150 second then case when attempts >= 25 then 'DEAD' else 'PENDING' end when last = 'click' then 'RUNNING' when last = 'view' then 'PENDING' when last = 'purchase' then 'DONE' when last = 'error' then 'FAILED' else 'DEAD' end as status from j, n"""


@query(_STALE)
def stale_job_detect(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    state = F.create_map(*map(F.lit, ("click", "RUNNING", "view", "PENDING", "purchase", "DONE", "error", "FAILED", "signup", "DEAD")))
    now = events.agg(F.max("ts")).first()[0]
    rows = events.groupBy(_k().alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("seen"), F.count(F.when(F.col("event_type") == "click", 1)).alias("attempts"))
    return J.stale(rows.withColumn("status", state[F.col("last")]), "job", F.lit(now), "attempts", most=25)


@query(f"""with e as (select event_id, {_K} as job, row_number() over (partition by {_K} order by ts, event_id) as attempts from events where event_type = 'error')
select event_id, job, attempts, case when attempts >= 6 then null else least(300, 20 * 2 ** (attempts - 1))::int end as wait, case when attempts >= 6 then 'DEAD' else 'PENDING' end as status from e""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "events").where("event_type = 'error'").select("event_id", _k().alias("job"), "ts")
    attempts = failed.withColumn("attempts", F.row_number().over(Window.partitionBy("job").orderBy("ts", "event_id")))
    return attempts.select("event_id", "job", "attempts", F.when(F.col("attempts") < 6, J.backoff_seconds(F.col("attempts"))).alias("wait"), F.when(F.col("attempts") >= 6, "DEAD").otherwise("PENDING").alias("status"))


@query("""with e as (select event_id, user_id, ts::date as day, count(*) filter (event_type <> 'error') over (partition by user_id, ts::date order by ts, event_id rows between unbounded preceding and 1 preceding) as used from events)
select event_id, user_id, used, used < 2 as admitted from e""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """Whether each query is within the user's day (here a limit of 2); only successful ones count."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.count(F.when(F.col("event_type") != "error", 1)).over(w)
    return table(spark, d, "events").select("event_id", "user_id", used.alias("used")).withColumn("admitted", F.col("used") < 2)


@query("select user_id, time_bucket(interval '15 minutes', ts, timestamp '1970-01-01') as started, count(*) as n from events group by all having count(*) > 1")
def fixed_window_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    return n.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query(f"select {_K} as job, arg_max(event_type, (ts, event_id)) as status, max(ts) as at from events group by 1")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(_k().alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


@query("select event_id, user_id, event_type from events")
def idempotent_events(spark: SparkSession, d: str) -> DataFrame:
    """A log in which every third event is delivered twice, each kept once."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.unionByName(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query("with p as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as place from events where event_type = 'view' and ts <= (select max(ts) - interval 5 day from events)) select user_id, event_id, place from p")
def queue_lag(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that can be claimed by a given time, in order of creation."""
    events = table(spark, d, "events")
    until = events.agg(F.expr("max(ts) - interval 5 day")).first()[0]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.where((F.col("event_type") == "view") & (F.col("ts") <= F.lit(until))).select("user_id", "event_id", place.alias("place"))


@query("select user_id, event_type, count(*) as n from events group by all")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by user and type from the event stream in update mode: the last batch's value of each key."""
    n = S.event_stream(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return S.drain(n, "update").groupBy("user_id", "event_type").agg(F.max_by("n", "_batch").alias("n"))


@query("select user_id, time_bucket(interval '15 minutes', ts, timestamp '1970-01-01') as started, count(*) as n from events group by all having count(*) > 1")
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    over = S.drain(S.rate_limit(S.event_stream(spark, d), 1), "update")
    return over.groupBy("user_id", "started").agg(F.max_by("n", "_batch").alias("n")).withColumn("started", F.col("started").cast("timestamp_ntz"))


@query("select user_id, ts::date as day, count(*) as used from events group by all")
def stream_daily_quota(spark: SparkSession, d: str) -> DataFrame:
    used = S.drain(S.daily_quota(S.event_stream(spark, d)), "update")
    return used.groupBy("user_id", F.to_date("day").alias("day")).agg(F.max_by("used", "_batch").alias("used"))


@query("select event_id, user_id from events")
def stream_idempotent(spark: SparkSession, d: str) -> DataFrame:
    return S.drain(S.once(S.event_stream(spark, d)), "append").select("event_id", "user_id")


@query(_SESSIONS)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """All sessions of the stream; its end closes the last ones."""
    end = S.end_folder(spark)
    closed = S.drain(S.session_windows(S.event_stream(spark, d, closing=end)), "append", closing=end)
    return closed.where("user_id is not null").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


@query(_BURSTS + "select user_id, started, count(*) as n from b group by user_id, burst, started")
def stream_bursts(spark: SparkSession, d: str) -> DataFrame:
    """All bursts of the stream; its end closes the last ones."""
    end = S.end_folder(spark)
    closed = S.drain(S.bursts(S.event_stream(spark, d, closing=end)), "append", closing=end)
    return closed.where("user_id is not null").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


_CHANGED = "docs2 as (select doc_id, case when doc_id % 7 = 0 then 'Revised. ' || text else text end as text from documents), "


@query(f"with {_CHANGED}{_CH.replace('from documents', 'from docs2')} select {_SHOW} from ch")
def stream_ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as a stream keeps them: new documents are cut and stored, changed ones replace their chunks, repeats do nothing."""
    chunks = S.ChunkSink(spark, ingest.scratch(spark, "stream-chunks"))
    changed = ingest.scratch(spark, "stream-changes")
    revised = table(spark, d, "documents").where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("Revised. "), "text"))
    revised.write.parquet(changed)
    S.drain(S.table_stream(spark, d, "documents"), "append", chunks.sink("documents"))
    S.drain(spark.readStream.schema(SCHEMAS["documents"]).parquet(changed), "append", chunks.sink("changes"))
    return _show(chunks.table.read())


@query(_STALE)
def stream_stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    """stale_job_detect by a stream with a timer for each running job: what each job came to, dead ones included."""
    mark = S.end_folder(spark)
    moves = S.drain(S.job_states(S.event_stream(spark, d, watermark="0 seconds", closing=mark), most=25), "update", closing=mark, at="1970-01-02")
    last = moves.where("job is not null").groupBy("job").agg(F.max_by("status", F.struct("_batch", "timed_out")).alias("status"))
    return last
