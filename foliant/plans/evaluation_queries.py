"""Queries of answer evaluation and benchmark building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators import evaluation as E
from foliant.operators.lineage import cut
from foliant.operators.ordering import ranked, summed
from foliant.plans.registry import query
from foliant.plans.retrieval_queries import gold_documents
from foliant.sources.store import small
from foliant.sources.tables import table

_TK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_PAIRS = "p as (select a.conv_id, a.turn, a.text as gold, b.text as answer from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("gold")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])


@query(f"""with {_PAIRS}, x as (select conv_id, turn, unnest({_TK.format('answer')}) as t, 1 as x, 0 as y from p union all select conv_id, turn, unnest({_TK.format('gold')}), 0, 1 from p),
n as (select conv_id, turn, t, sum(x) as x, sum(y) as y from x group by all), c as (select conv_id, turn, sum(least(x, y)) as c from n group by all)
select p.conv_id, p.turn, round(case when len({_TK.format('answer')}) + len({_TK.format('gold')}) = 0 then 1 when coalesce(c, 0) = 0 then 0 else 2.0 * c / (len({_TK.format('answer')}) + len({_TK.format('gold')})) end, 6)::double as f1 from p left join c using (conv_id, turn)""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return E.token_f1(_pairs(spark, d), ["conv_id", "turn"], T.tokenize(F.col("answer")), T.tokenize(F.col("gold")))


_ANS = "a as (select l.doc_id, source as book, case when l.doc_id % 2 = 0 then 'open' else 'system' end as condition, l.quality = 0 as impossible, l.toxic = 1 as abstained, n_chars > 1500 as right_answer, lang <> 'en' as wrong from labels l join documents using (doc_id))"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Labels as judged answers: two conditions, impossible questions, refusals."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars", "lang"), "doc_id")
    return rows.select("doc_id", F.col("source").alias("book"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("system").alias("condition"), (F.col("quality") == 0).alias("impossible"), (F.col("toxic") == 1).alias("abstained"), (F.col("n_chars") > 1500).alias("right_answer"), (F.col("lang") != "en").alias("wrong"))


@query(f"""with {_ANS} select book, condition, count(*) as n, round(avg(case when not impossible then right_answer::int end), 6) as accuracy, round(avg(case when not impossible then abstained::int end), 6) as over_abstention,
round(avg(case when impossible then (not abstained)::int end), 6) as hallucination, round(avg(wrong::int), 6) as wrong_language from a group by all""")
def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c, when=None: F.round(F.avg(F.when(when, c.cast("int")) if when is not None else c.cast("int")), 6)
    possible, impossible = ~F.col("impossible"), F.col("impossible")
    return _answers(spark, d).groupBy("book", "condition").agg(F.count("*").alias("n"), mean(F.col("right_answer"), possible).alias("accuracy"), mean(F.col("abstained"), possible).alias("over_abstention"), mean(~F.col("abstained"), impossible).alias("hallucination"), mean(F.col("wrong")).alias("wrong_language"))


@query(f"""with {_ANS}, p as (select book, condition, k, (doc_id + k) % 3 = 0 as cited, (doc_id * 7 + k) % 5 < 2 and right_answer as evidence from a, (select unnest([1, 2, 3, 4, 5]) as k) s)
select condition, round(avg(case when cited then evidence::int end), 6) as cited_support, round(avg(case when not cited then evidence::int end), 6) as uncited_support from p group by condition""")
def citation_support(spark: SparkSession, d: str) -> DataFrame:
    passages = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct((((F.col("doc_id") + k) % 3) == 0).alias("cited"), (((F.col("doc_id") * 7 + k) % 5 < 2) & F.col("right_answer")).alias("evidence")))
    p = _answers(spark, d).select("condition", F.explode(passages).alias("p"))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("p.evidence").cast("int"))), 6)
    return p.groupBy("condition").agg(mean(F.col("p.cited")).alias("cited_support"), mean(~F.col("p.cited")).alias("uncited_support"))


@query("""with n as (select source, count(*) filter (quality = 1 and toxic = 0) as a, count(*) filter (quality = 0 and toxic = 1) as b from labels join documents using (doc_id) group by source)
select source, a as only_a, b as only_b, round(case when a + b = 0 then 1 else least(1, 2 * (select sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) from (select unnest(range(0, least(n.a, n.b) + 1)) as i))) end, 6)::double as p from n""")
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = rows.groupBy("source").agg(F.count(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1)).alias("only_a"), F.count(F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1)).alias("only_b"))
    return n.select("source", "only_a", "only_b", F.round(E.mcnemar_p(F.col("only_a"), F.col("only_b")), 6).alias("p"))


_CAP = r"[A-ZÀ-Þ][\p{L}]{4,}"


#: A capitalised word and the word after it, if a blank parts them.
_NAME = r"[A-ZÀ-Þ]\p{L}+(?: \p{L}+)?"


def _forms_sql(name: str) -> str:
    """A name's two forms: as it is, and without a qualifier at its end; blanks folded."""
    folded = "trim(regexp_replace(lower({0}), '[\\s\\p{{Z}}]+', ' ', 'g'))".format
    bare = f"regexp_replace({name}, '\\s*\\([^()]*\\)\\s*$', '')"
    return f"[{folded(name)}, {folded(bare)}]"


def _same_sql(a: str, b: str) -> str:
    held = "contains(' ' || p || ' ', ' ' || q || ' ') or contains(' ' || q || ' ', ' ' || p || ' ')"
    inner = f"len(list_filter({_forms_sql(b)}, lambda q: length(p) >= 3 and length(q) >= 3 and ({held}))) > 0"
    return f"len(list_filter({_forms_sql(a)}, lambda p: {inner})) > 0"


_CHAIN = "select distinct conv_id, l[i] as a, l[i + 1] as b from (select conv_id, l, unnest(range(1, len(l))) as i from turns where role {0} 'user')"


@query(f"""with turns as (select conv_id, role, regexp_extract_all(text, '{_NAME}') as l from conversations),
u as (select distinct conv_id, unnest(l) as name from turns where role = 'user'), r as (select distinct conv_id, unnest(l) as other from turns where role <> 'user'),
m as (select u.conv_id, name, other from u join r on u.conv_id = r.conv_id where {_same_sql("name", "other")}),
t as ({_CHAIN.format("=")}), f as ({_CHAIN.format("<>")}),
h as (select distinct t.conv_id, t.a, t.b from t join m x on x.conv_id = t.conv_id and x.name = t.a join m y on y.conv_id = t.conv_id and y.name = t.b
    join f on f.conv_id = t.conv_id and ((f.a = x.other and f.b = y.other) or (f.a = y.other and f.b = x.other)))
select u.conv_id, count(*) as entities, count(*) filter ((u.conv_id, name) in (select (conv_id, name) from m)) as found,
    coalesce((select count(*) from t where t.conv_id = u.conv_id), 0) as triples, coalesce((select count(*) from h where h.conv_id = u.conv_id), 0) as triples_found from u group by u.conv_id""")
def entity_relation_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the entities and relations of a dialogue's user turns the replies name too, in either direction.

    Names are the same if one holds the other as whole words. Relations are consecutive names of a turn.
    """
    turns = table(spark, d, "conversations").select("conv_id", (F.col("role") == "user").alias("asked"), F.regexp_extract_all("text", F.lit(_NAME), 0).alias("l")).where("role is not null")
    return E.graph_recall(turns)


@query("""with s as (select d.doc_id, b.item_id, position(b.text in d.text) - 1 as start from benchmark b join documents d on contains(d.text, b.text)), o as (select source, doc_id, coalesce(sum(n_chars + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as base from documents)
select source as book, item_id, doc_id, base + start as start from s join o using (doc_id)""")
def benchmark_build(spark: SparkSession, d: str) -> DataFrame:
    """Books of a source's documents, with the absolute place of every span that can be located."""
    docs = table(spark, d, "documents", False)
    sizes = docs.select(F.col("source").alias("book"), "doc_id", (F.col("n_chars") + 2).alias("room"))
    base = summed(sizes, "book", "room", "doc_id").select("book", "doc_id", F.col("before").alias("base"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("needle"))
    found = small(cut(gold_documents(spark, d).join(items, "query")))  # so that no text is shuffled for them
    spans = found.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select(F.col("id").alias("doc_id"), F.col("query").alias("item_id"), (F.expr("position(needle in text)") - 1).alias("start"))
    return spans.join(base, "doc_id").select("book", "item_id", "doc_id", (F.col("base") + F.col("start")).alias("start"))


@query("""with o as (select o_orderkey as item, row_number() over (partition by o_custkey order by o_orderkey) as k from orders), t as (select item from o where k % 2 = 1)
select item, case when row_number() over (order by item) % 2 = 1 then 'A' else 'B' end as grp from t""")
def series_select(spark: SparkSession, d: str) -> DataFrame:
    """Items taken in order of their id so that no two share a paragraph, in two groups by turns.

    Here a customer's orders are items of which each shares a paragraph with the next one.
    """
    placed = cut(ranked(table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey"), "o_custkey", "item"))
    ahead = placed.select(F.col("item").alias("b"), "o_custkey", (F.col("place") - 1).alias("place"))
    links = placed.select(F.col("item").alias("a"), "o_custkey", "place").join(ahead, ["o_custkey", "place"]).select("a", "b")
    taken = ranked(E.independent_first(placed.select("item"), links).withColumn("whole", F.lit(0)), "whole", "item")
    return taken.select("item", F.when(F.col("place") % 2 == 0, "A").otherwise("B").alias("grp"))


#: Rounds that the check of leaks is written out for; the loop itself has no such bound and stops where nothing leaks.
_LEAK_ROUNDS = 10


def _leak_sql() -> str:
    rounds = ["x0 as (select item_id from benchmark where false)"]
    for r in range(_LEAK_ROUNDS):
        rounds.append(f"p{r} as materialized (select item_id, text, answer, row_number() over (order by item_id) - 1 as place from b where item_id not in (select item_id from x{r}) qualify place < most)")
        leaking = f"select q.item_id from p{r} q where exists (select 1 from p{r} v where v.place % 2 <> q.place % 2 and q.answer <> '' and contains(lower(v.text), q.answer))"
        rounds.append(f"x{r + 1} as materialized (select item_id from x{r} union {leaking})")
    last = _LEAK_ROUNDS - 1
    return f"""with b as (select item_id, text, lower(regexp_extract(text, '^\\S+ \\S+')) as answer, (select (count(*) * 3 + 3) // 4 from benchmark) as most from benchmark), {", ".join(rounds)}
        select item_id, case when place % 2 = 0 then 'A' else 'B' end as grp from p{last} where not exists (select 1 from x{last + 1} where item_id not in (select item_id from x{last}))"""


@query(_leak_sql())
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters of the items, in two groups by turns, none of whose answers (the first two words) stands in the other group's texts.

    Items that leak go, the next ones take their places, and the groups change with that: until a round finds none.
    """
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text", F.lower(F.regexp_extract("text", r"^\S+ \S+", 0)).alias("answer"))
    return E.leak_free(items, 0.75).select(F.col("item").alias("item_id"), F.when(F.col("place") % 2 == 0, "A").otherwise("B").alias("grp"))


@query(f"""with n as (select distinct conv_id, lower(unnest(regexp_extract_all(text, '{_CAP}'))) as name from conversations), c as (select conv_id, count(*) as entities from n group by conv_id having count(*) >= 3),
t as (select conv_id, count(*) as turns from conversations group by conv_id having count(*) >= 2), r as (select conv_id, entities, turns, row_number() over (order by conv_id) as place from c join t using (conv_id)) select * from r where place <= 40""")
def dialogue_select(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 dialogues with three named entities and two turns at least: a selection of 40 by design."""
    c = table(spark, d, "conversations")
    names = c.select("conv_id", F.explode_outer(F.regexp_extract_all("text", F.lit(_CAP), 0)).alias("name")).where("name is not null").groupBy("conv_id").agg(F.count_distinct(F.lower("name")).alias("entities")).where("entities >= 3")
    turns = c.groupBy("conv_id").agg(F.count("*").alias("turns")).where("turns >= 2")
    best = names.join(turns, "conv_id").orderBy("conv_id").limit(40)
    return best.select("conv_id", "entities", "turns", F.row_number().over(Window.orderBy("conv_id")).alias("place"))
