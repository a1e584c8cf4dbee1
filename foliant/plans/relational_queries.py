"""Queries over owners, documents, jobs and reading: filters, joins, aggregates, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import relational as R
from foliant.plans.registry import query
from foliant.sources.tables import table

#: SQL of a props key.
K = "json_extract(props, '$.k')::int"


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


@query("select doc_id, lang, n_chars from documents where source = 'src0' or doc_id in (select doc_id from labels where quality = 1)")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    return docs.join(good, "doc_id", "left").where("source = 'src0' or good").select("doc_id", "lang", "n_chars")


@query("select o_orderkey, o_custkey from orders join customer on o_custkey = c_custkey where c_nationkey = 3")
def owner_filter(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return R.in_scope(table(spark, d, "orders").select("o_orderkey", "o_custkey"), owners, "o_custkey")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def assert_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Orders that claim an owner who isn't in good standing."""
    owners = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.out_of_scope(table(spark, d, "orders").select("o_orderkey", "o_custkey"), owners, "o_custkey")


@query(f"select event_id, {K} as k from events where {K} = 42 and json_extract(props, '$.text') is null")
def payload_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where((_k() == 42) & F.get_json_object("props", "$.text").isNull()).select("event_id", _k().alias("k"))


@query("""select 'conversations' as source, role as value, count(*) as n from conversations where role not in ('user', 'assistant') group by role
union all select 'orders', o_orderstatus, count(*) from orders where o_orderstatus not in ('O', 'F') group by o_orderstatus""")
def enum_check(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "conversations").where(~F.col("role").isin("user", "assistant")).select(F.lit("conversations").alias("source"), F.col("role").alias("value"))
    states = table(spark, d, "orders").where(~F.col("o_orderstatus").isin("O", "F")).select(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("value"))
    return roles.unionByName(states).groupBy("source", "value").agg(F.count("*").alias("n"))


@query("""with p as (select c_custkey as k, case when c_custkey % 2 = 0 then upper(c_name) end as nm, case when c_custkey % 3 = 0 then 'X' end as sg from customer where c_custkey % 5 < 2)
select c_custkey, coalesce(nm, c_name) as c_name, coalesce(sg, c_mktsegment) as c_mktsegment from customer left join p on k = c_custkey""")
def coalesce_patch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = rows.where("c_custkey % 5 < 2").select("c_custkey", F.expr("case when c_custkey % 2 = 0 then upper(c_name) end").alias("c_name"), F.expr("case when c_custkey % 3 = 0 then 'X' end").alias("c_mktsegment"))
    return R.patch(rows, changes, "c_custkey", ["c_name", "c_mktsegment"])


@query("select vec_id, label, lang, n_chars from embeddings join documents on doc_id = vec_id")
def corpus_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "label", "lang", "n_chars")


@query("select c_custkey, c_name, count(o_orderkey) as n_documents, max(o_orderdate) as latest from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name")
def workspace_doc_count(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("latest"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(counted, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_documents"), "latest")


@query("select c.conv_id, turn, role, row_number() over (partition by c.conv_id order by turn) as place from conversations c join customer on c_custkey = c.conv_id where c_nationkey < 12")
def session_history(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("conv_id"))
    rows = R.in_scope(table(spark, d, "conversations").select("conv_id", "turn", "role"), owners, "conv_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


@query("select vec_id, label, round(embedding[1], 5) as first_value from embeddings where vec_id in (select doc_id from labels where toxic = 1)")
def batch_lookup_by_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return R.in_scope(table(spark, d, "embeddings"), wanted, "vec_id").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value"))


@query("""with a as (select doc_id, case when doc_id % 4 = 0 then 1 - quality else quality end as given from labels where doc_id % 10 < 7)
select l.doc_id, given = quality as correct from labels l join a on a.doc_id = l.doc_id""")
def quiz_check_join(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "quality")
    answers = labels.where("doc_id % 10 < 7").select(F.create_map("doc_id", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).alias("answers"))
    given = answers.select(F.explode("answers").alias("doc_id", "given"))
    return labels.join(given, "doc_id").select("doc_id", (F.col("given") == F.col("quality")).alias("correct"))


@query("select event_type, count(*) as n, max(ts) as latest from events group by event_type")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def relation_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("select conv_id, count(*) as n_messages, arg_min(text, turn) as first_text, count(*) <= 2 as first_exchange from conversations group by conv_id")
def message_count_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min_by("text", "turn").alias("first_text"), (F.count("*") <= 2).alias("first_exchange"))


@query(f"""select {K} % 10 as job_type, count(*) filter (event_type = 'view') as pending, count(*) filter (event_type = 'click') as running, count(*) filter (event_type = 'purchase') as done,
count(*) filter (event_type = 'error') as failed, count(*) filter (event_type = 'signup') as dead from events group by 1""")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    states = {"view": "pending", "click": "running", "purchase": "done", "error": "failed", "signup": "dead"}
    pivoted = table(spark, d, "events").groupBy((_k() % 10).alias("job_type")).pivot("event_type", list(states)).agg(F.count(F.lit(1)))
    return pivoted.select("job_type", *(F.coalesce(k, F.lit(0)).alias(v) for k, v in states.items()))


@query("select lower(trim(p_name)) as name, count(*) as n, min(p_partkey) as first_key from part group by 1 having count(*) > 1")
def duplicate_name_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as k, count(*) over (partition by event_type) as n from events)
select event_type, max(value) filter (k = least(floor(0.95 * n) + 1, n)) as p95, max(value) filter (k = least(floor(0.99 * n) + 1, n)) as p99 from r group by event_type""")
def percentile_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    p95, p99 = (R.percentile_exact(rows, ["event_type"], "value", s, "event_id").withColumnRenamed("value", n) for s, n in ((0.95, "p95"), (0.99, "p99")))
    return p95.join(p99, "event_type")


@query(f"""with r as (select {K} as doc_id, event_type, ts, event_id, row_number() over (partition by {K} order by ts desc, event_id desc) as k from events)
select doc_id, event_type as status, ts from r where k = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(_k().alias("doc_id"), F.col("event_type").alias("status"), "ts", "event_id")
    return R.first_per_key(rows, ["doc_id"], F.col("ts").desc(), F.col("event_id").desc()).drop("event_id")


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as place from orders) select * from r where place <= 3")
def latest_first_list(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place")).where("place <= 3")


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents in an order that a seed fixes; a sampling operator, so the limit is what it does."""
    return table(spark, d, "documents").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(100).select("doc_id", "source")


@query("""select a.doc_id, list_sort(list_intersect(list_distinct(string_split(a.source || ' ' || a.lang, ' ')), list_distinct(string_split('src0 en', ' '))))::varchar as common from documents a""")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "source", "lang"), " ")
    both = F.array_sort(F.array_intersect(words, F.split(F.lit("src0 en"), " ")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("common"))


@query(f"select {K} as doc_id, user_id, max(value) as last_page, max(ts) as at from events where event_type = 'view' and (user_id, {K}, ts) in (select (user_id, {K}, max(ts)) from events where event_type = 'view' group by user_id, {K}) group by 1, 2")
def reading_progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'view'").groupBy(_k().alias("doc_id"), "user_id").agg(F.max_by("value", F.struct("ts", "value")).alias("last_page"), F.max("ts").alias("at"))


@query("""with p as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as reply, min(case when role = 'user' then turn end) over (partition by conv_id) as first_turn
  from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, length(text) as asked, length(reply) as answered, case when turn = first_turn then case when length(text) > 60 then rtrim(left(text, 60), ' ') || '…' else text end end as title
from p where role = 'user' and next_role = 'assistant'""")
def record_exchange(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions.text import session_title

    w = Window.partitionBy("conv_id")
    c = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w.orderBy("turn")), "reply": F.lead("text").over(w.orderBy("turn")), "first_turn": F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w)})
    pairs = c.where("role = 'user' and next_role = 'assistant'")
    return pairs.select("conv_id", "turn", F.length("text").alias("asked"), F.length("reply").alias("answered"), F.when(F.col("turn") == F.col("first_turn"), session_title(F.col("text"))).alias("title"))


_LATEST = f"latest as (select doc_id, event_type as job from (select {K} as doc_id, event_type, row_number() over (partition by {K} order by ts desc, event_id desc) as k from events) where k = 1)"


@query(f"""with {_LATEST}, n as (select l_orderkey as doc_id, count(*) as relations from lineitem group by 1)
select d.doc_id, l.job, case when length(trim(d.text)) > 0 then 'READY' else 'FAILED' end as status, coalesce(n.relations, 0) as relations from documents d left join latest l using (doc_id) left join n using (doc_id)""")
def extraction_status(spark: SparkSession, d: str) -> DataFrame:
    jobs = latest_per_key(spark, d).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("status").alias("job"))
    relations = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.length(F.trim("text")) > 0, "READY").otherwise("FAILED").alias("status"))
    return docs.join(jobs, "doc_id", "left").join(relations, "doc_id", "left").select("doc_id", "job", "status", F.coalesce("n", F.lit(0)).alias("relations"))


@query(f"""with {_LATEST}, wanted as (select distinct l_partkey as doc_id from lineitem)
select w.doc_id, case when d.doc_id is null then 'not_found' when length(trim(d.text)) = 0 then 'not_ready' when l.job in ('view', 'click') then 'already_queued' else 'queued' end as outcome
from wanted w left join documents d using (doc_id) left join latest l using (doc_id)""")
def request_extraction_plan(spark: SparkSession, d: str) -> DataFrame:
    jobs = latest_per_key(spark, d).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("status").alias("job"))
    docs = table(spark, d, "documents").select("doc_id", (F.length(F.trim("text")) == 0).alias("blank"))
    wanted = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id")).distinct()
    outcome = F.when(F.col("blank").isNull(), "not_found").when(F.col("blank"), "not_ready").when(F.col("job").isin("view", "click"), "already_queued").otherwise("queued")
    return wanted.join(docs, "doc_id", "left").join(jobs, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


@query("""with gone as (select c_custkey from customer where c_nationkey = 5), o as (select o_orderkey from orders where o_custkey not in (select c_custkey from gone))
select l_orderkey, l_linenumber, o.o_orderkey as document from lineitem left join o on o.o_orderkey = l_orderkey""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """After owners are deleted their documents go; relations stay and lose the document."""
    gone = table(spark, d, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    left = R.out_of_scope(table(spark, d, "orders"), gone, "o_custkey").select(F.col("o_orderkey").alias("document"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(left, F.col("document") == F.col("l_orderkey"), "left")


@query("""with g as (select source, lower(trim(case when doc_id % 3 = 0 then ' Good ' when quality = 1 then 'good' else 'BAD' end)) = case when quality = 1 then 'good' else 'bad' end as ok from labels join documents using (doc_id))
select source, count(*) as total, sum(ok::int) as score, round(100.0 * sum(ok::int) / count(*), 1) as percentage from g group by source""")
def quiz_grade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    given = F.when(F.col("doc_id") % 3 == 0, " Good ").when(F.col("quality") == 1, "good").otherwise("BAD")
    ok = (F.lower(F.trim(given)) == F.when(F.col("quality") == 1, "good").otherwise("bad")).cast("int")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.sum(ok).alias("score"), F.round(100.0 * F.sum(ok) / F.count("*"), 1).alias("percentage"))


@query("with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as k from labels join documents using (doc_id)) select * from r where k <= 10")
def quiz_by_document(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("k")).where("k <= 10")


@query("select doc_id, left(text, 80) as front, case quality when 1 then 'good' else 'bad' end || E'\\n\\n' || 'toxic: ' || toxic as back from labels join documents using (doc_id)")
def flashcards(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.left("text", F.lit(80)).alias("front"), F.concat_ws("\n\n", F.when(F.col("quality") == 1, "good").otherwise("bad"), F.concat(F.lit("toxic: "), "toxic")).alias("back"))


@query("select doc_id, quality, toxic, coalesce(case when quality = 1 then 'easy' end, 'medium') as difficulty from labels")
def quiz_parse(spark: SparkSession, d: str) -> DataFrame:
    """Questions from a model's JSON, with defaults for what it leaves out."""
    raw = F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "quality": '), "quality", F.lit(', "toxic": '), "toxic", F.when(F.col("quality") == 1, ', "difficulty": "easy"}').otherwise("}"))
    parsed = table(spark, d, "labels").select(F.from_json(raw, "doc_id long, quality int, toxic int, difficulty string").alias("q")).select("q.*")
    return parsed.withColumn("difficulty", F.coalesce("difficulty", F.lit("medium")))


@query("""select o_orderkey, o_orderdate, case when o_totalprice > 100000 then 1 else 0 end as page, o_totalprice as x, o_totalprice * 2 as width,
row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders""")
def highlights_by_document(spark: SparkSession, d: str) -> DataFrame:
    """A document's highlights in order, their place unfolded from the nested location."""
    rect = F.struct(F.col("o_totalprice").alias("x"), (F.col("o_totalprice") * 2).alias("width"))
    meta = F.struct(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("page"), F.array(rect).alias("rects"))
    rows = table(spark, d, "orders").withColumn("location", meta)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return rows.select("o_orderkey", "o_orderdate", "location.page", F.col("location.rects")[0]["x"].alias("x"), F.col("location.rects")[0]["width"].alias("width"), place.alias("place"))


@query("select l_partkey, l_suppkey, l_returnflag from lineitem group by all having count(*) > 0 and not bool_or(l_linestatus = 'O')")
def relation_insert_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Closed relations that aren't already known as open ones (null-safe), each once."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    return R.null_safe_missing(rows.where("l_linestatus != 'O'").select(*keys).distinct(), rows.where("l_linestatus = 'O'").select(*keys), keys)
