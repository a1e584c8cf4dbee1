"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans.registry import query
from foliant.sources.tables import table

#: SQL for squeezed white space, tokens and a padded token string of an expression.
SQ = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"
TK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_words = lambda words: "|".join(words)


@query("select doc_id, md5(" + SQ.format("lower(nfc_normalize(text))") + ") as normal_md5, length(" + SQ.format("lower(nfc_normalize(text))") + ") as n from documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    x = T.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", F.md5("x").alias("normal_md5"), F.length("x").cast("long").alias("n"))


@query("select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, " + TK.format("text") + " as t from documents)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(r"select doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' all rights reserved ') as found from documents")
def contains_phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.contains_phrase(F.col("text"), F.lit("All  rights reserved")).alias("found"))


@query(f"select doc_id, left({SQ.format('text')}, 200) as name from documents")
def clean_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_name(F.col("text")).alias("name"))


@query("select doc_id, md5(translate(lower(text), '‐‑‒–—―‘’‚“”„«»', '------''''''\"\"\"\"\"')) as folded_md5 from documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold_text(F.col("text"))).alias("folded_md5"))


@query(r"""
with w as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda x: x <> '')) as s from conversations),
p as (select a.conv_id, a.turn, a.s as x, b.s as y from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, round(case when len(list_distinct(x || y)) = 0 then 0 else len(list_intersect(x, y)) / len(list_distinct(x || y)) end, 6) as similarity from p""")
def jaccard_words(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard_words(F.col("text"), F.col("next_text")), 6).alias("similarity"))


@query("""
with n as (select vec_id, embedding as e, lead(embedding) over (partition by label order by vec_id) as f from embeddings)
select vec_id, round(list_sum(list_transform(list_zip(e, f), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(f, lambda x: x::double * x::double)))), 5) as cosine
from n where f is not null""")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("f", F.expr("lead(embedding) over (partition by label order by vec_id)")).where("f is not null")
    return e.select("vec_id", F.round(T.cosine_similarity(F.col("embedding"), F.col("f")), 5).alias("cosine"))


@query("select conv_id, turn, case when length(text) > 60 then rtrim(left(text, 60), ' ') || '…' else text end as title from conversations where role = 'user'")
def session_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.session_title(F.col("text")).alias("title"))


@query(r"""
with c as (select conv_id, turn, left(text, 40) || ' [' || turn || ']. B [2, ' || (conv_id % 7) || '] C [9;1] [x] [3][3]' as t from conversations),
n as (select conv_id, turn, list_transform(flatten(list_transform(regexp_extract_all(t, '\[(\d{1,6}(?:\s*[,;]\s*\d{1,6})*)\]', 1), lambda g: regexp_split_to_array(g, '\s*[,;]\s*'))), lambda x: x::int) as k from c)
select conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(k, lambda x: x between 1 and 5))), ',') as cited from n""")
def cited_indices(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.left("text", F.lit(40)), F.lit(" ["), "turn", F.lit("]. B [2, "), F.col("conv_id") % 7, F.lit("] C [9;1] [x] [3][3]"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.cited_indices(marked, F.lit(5)), ",").alias("cited"))


@query("select conv_id, turn, md5(regexp_replace(text || ' 【' || turn || '†' || role || '】 【x】', '【(\\d+)[^】]*】', '[\\1]', 'g')) as normal_md5 from conversations")
def normalize_citations(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat("text", F.lit(" 【"), "turn", F.lit("†"), "role", F.lit("】 【x】"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.normalize_citations(marked)).alias("normal_md5"))


@query(f"select doc_id, regexp_matches(text, '{T.CJK}') as cjk from documents")
def detect_cjk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.detect_cjk(F.col("text")).alias("cjk"))


@query(f"select doc_id, regexp_matches(lower(text), '{T.VIETNAMESE}') as vietnamese from documents")
def detect_vietnamese(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.detect_vietnamese(F.col("text")).alias("vietnamese"))


_EN = f"(len(regexp_extract_all(lower({{0}}), '\\b({_words(T.ENGLISH_WORDS)})\\b')) > 0 and not regexp_matches(lower({{0}}), '{T.VIETNAMESE}'))"
_ROM = f"len(regexp_extract_all(lower({{0}}), '\\b({_words(T.ROMANCE_WORDS)})\\b')) >= 2"


@query(f"select doc_id, {_EN.format('text')} as english from documents where lang = 'en'")
def is_english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", T.is_english(F.col("text")).alias("english"))


@query(f"select language, count(*) as n from (select case when regexp_matches(lower(text), '{T.VIETNAMESE}') then 'Vietnamese' when {_EN.format('text')} then 'English' else 'the language of the question' end as language from benchmark) group by language")
def question_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(T.question_language(F.col("text")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query(f"""
with p as (select a.conv_id, a.turn, a.text as q, b.text as r from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user')
select conv_id, turn, (not regexp_matches(q, '{T.CJK}') and regexp_matches(r, '{T.CJK}'))
  or case when regexp_matches(lower(q), '{T.VIETNAMESE}') then not regexp_matches(lower(r), '{T.VIETNAMESE}') else {_EN.format("q")} and not {_EN.format("r")} and {_ROM.format("r")} end as slip from p""")
def is_language_slip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.where("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.is_language_slip(F.col("text"), F.col("reply")).alias("slip"))


_NA = r"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\[\d+(?:\s*[,;]\s*\d+)*\]', ' ', 'g'), '[\p{{P}}\p{{S}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), ' '), lambda w: w not in ('a', 'an', 'the')), ' ')"


@query(f"select doc_id, md5({_NA.format('text')}) as answer_md5 from documents where lang = 'en'")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.md5(T.normalize_answer(F.col("text"))).alias("answer_md5"))


@query(f"select doc_id, lang = 'en' and (contains(' ' || {_NA.format('text')} || ' ', ' all rights reserved ') or contains(' ' || {_NA.format('text')} || ' ', ' mit license ')) as found from documents where lang = 'en'")
def contains_answer(spark: SparkSession, d: str) -> DataFrame:
    golds = F.array(F.lit("All rights reserved!"), F.lit("the MIT License"), F.lit(" "))
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", T.contains_answer(F.col("text"), golds).alias("found"))


_REF = "|".join(T.REFUSALS).replace("'", "''")


@query(f"select conv_id, turn, regexp_matches(lower(case turn % 3 when 0 then left(text, 50) || ' is not mentioned here' when 1 then 'Tài liệu không đề cập' else text end), '{_REF}') as declined from conversations")
def abstained(spark: SparkSession, d: str) -> DataFrame:
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.left("text", F.lit(50)), F.lit(" is not mentioned here"))).when(F.col("turn") % 3 == 1, "Tài liệu không đề cập").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.abstained(answer).alias("declined"))


@query(f"select conv_id, turn, regexp_matches(text, '{T.HAN}') as wrong from conversations")
def wrong_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.wrong_language(F.col("text")).alias("wrong"))


@query("select event_id, json_extract(props, '$.k')::int as k from events")
def parse_json_object(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("Here it is: ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", F.variant_get(T.parse_json_object(answer), "$.k", "int").alias("k"))


@query("select event_id, user_id::varchar as subject, event_type as relation, json_extract_string(props, '$.k') as object, case when event_id % 2 = 0 then 0.5 else 0.8 end::double as confidence from events")
def parse_triplets(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    given = F.when(F.col("event_id") % 2 == 0, F.lit(', "confidence": 0.5')).otherwise("")
    answer = F.concat(F.lit('Sure: [{"subject": " '), "user_id", F.lit('", "relation": "'), "event_type", F.lit('", "object": "'), k, F.lit(' "'), given, F.lit('}, {"subject": "x"}] ok'))
    t = table(spark, d, "events").select("event_id", F.explode_outer(T.parse_triplets(answer)).alias("t"))
    return t.select("event_id", "t.subject", "t.relation", "t.object", "t.confidence")


@query("select event_id, case when event_id % 3 = 0 then null else json_extract(props, '$.k')::int end as k from events")
def parse_fenced_json(spark: SparkSession, d: str) -> DataFrame:
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("no json")).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("Text ```json\n"), "props", F.lit("\n``` more")))
    return table(spark, d, "events").select("event_id", F.variant_get(T.parse_fenced_json(answer), "$.k", "int").alias("k"))


@query(r"""
with x as (select doc_id, list_transform(string_split('- ' || replace(text, '. ', E'.\n* '), E'\n'), lambda l: regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as l from documents),
k as (select doc_id, list_transform(list_filter(l, lambda y: regexp_matches(y, '^[-*•]')), lambda y: regexp_replace(regexp_replace(y, '^[-*•]+', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))[1:10] as p from x)
select doc_id, len(p)::int as n_points, md5(array_to_string(p, '|')) as points_md5 from k""")
def key_points(spark: SparkSession, d: str) -> DataFrame:
    points = T.key_points(F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit(".\n* "))))
    return table(spark, d, "documents").select("doc_id", points.alias("p")).select("doc_id", F.size("p").alias("n_points"), F.md5(F.array_join("p", "|")).alias("points_md5"))


@query(r"select p_partkey, regexp_replace(p_name || ' (' || p_brand || ')', '\s*\([^()]*\)\s*$', '') as name from part")
def strip_qualifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.strip_qualifier(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("""
with p as (select p_partkey, lower(p_name) as a, lower(split_part(p_name, ' ', 1)) as b from part)
select p_partkey, length(a) >= 3 and length(b) >= 3 and (contains(' ' || a || ' ', ' ' || b || ' ') or contains(' ' || b || ' ', ' ' || a || ' ')) as same from p""")
def same_entity(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.concat("p_name", F.lit(" (part)")), F.upper(F.split("p_name", " ")[0])
    return table(spark, d, "part").select("p_partkey", T.same_entity(a, b).alias("same"))


@query("""
with o as (select doc_id, unnest(range(1, length(text) - 1)) as s, text from documents),
h as (select doc_id, s - 1 as place from o where substr(text, s, 3) = 'the'),
r as (select doc_id, place, row_number() over (partition by doc_id order by abs(place - 100), place) as k from h)
select d.doc_id, r.place::int as place from documents d left join r on r.doc_id = d.doc_id and k = 1""")
def nearest_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.nearest_occurrence(F.col("text"), F.lit("the"), F.lit(100)).alias("place"))


@query("select event_id, least(20, greatest(1, coalesce(case when json_extract(props, '$.k')::int % 5 = 0 then null else json_extract(props, '$.k')::int - 40 end, 5))) as k from events")
def safe_top_k(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", T.safe_top_k(F.when(k % 5 != 0, k - 40)).alias("k"))


def _score(domain: str) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in T.DOMAINS[domain]) + ")"


_BEST = f"greatest({', '.join(map(_score, T.DOMAINS))})"


@query(f"select doc_id, case when {_BEST} = 0 then 'general' {' '.join(f'when {_score(x)} = {_BEST} then {chr(39)}{x}{chr(39)}' for x in T.DOMAINS)} end as domain from documents")
def detect_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.detect_domain(F.col("text")).alias("domain"))


@query(f"""
with q as (select o_orderkey, case o_orderkey % 4 when 0 then 'Legal' when 1 then 'Software house' when 2 then 'finance' else o_orderpriority end as x from orders)
select o_orderkey, case {' '.join(f"when lower(x) = '{k}' then '{k}'" for k in T.DOMAINS)} {' '.join(f"when regexp_matches(lower(x), '{_words(v)}') then '{k}'" for k, v in T.DOMAINS.items())} else 'general' end as domain from q""")
def route_domain(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, "Legal").when(k == 1, "Software house").when(k == 2, "finance").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", T.route_domain(x).alias("domain"))
