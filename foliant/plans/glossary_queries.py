"""Queries of terms and glossaries: a source's glossary comes from the terms of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.operators import glossary as G
from foliant.operators.ordering import ranked
from foliant.plans.registry import query
from foliant.sources.tables import table

_TERMS = f"list_filter(list_distinct(regexp_extract_all(text, '{G.WORD}')), lambda w: regexp_matches(w, '{G.TERM}'))"
_T = f"t as (select doc_id, source, unnest({_TERMS}) as term from documents)"
_G = f"""{_T}, u as (select source, term, doc_id, term || ' in ' || doc_id as definition from t),
g as (select source, term, count(distinct doc_id) as frequency, arg_min(definition, (-length(definition), doc_id)) as definition, min(doc_id) as source_document from u group by source, term)"""


def terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.explode_outer(G.technical_terms(F.col("text"))).alias("term")).where("term is not null")


def glossary(spark: SparkSession, d: str) -> DataFrame:
    """The terms of all documents, merged for each source."""
    return G.upsert(terms(spark, d).withColumn("definition", F.concat("term", F.lit(" in "), "doc_id")), "source", "term", "definition", "doc_id")


@query(f"with {_T} select doc_id, count(*) as n, md5(string_agg(term, '|' order by term)) as terms_md5 from t group by doc_id")
def technical_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), "|")).alias("terms_md5"))


@query(f"with {_T} select doc_id, lower(term) as key, arg_min(term, term) as term from t where length(term) > 2 group by 1, 2")
def entity_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = terms(spark, d).where("length(term) > 2").withColumn("place", F.lit(0))
    return G.first_spelling(kept, "term", "place", "doc_id")


@query(f"with {_T} select doc_id, term from t")
def glossary_extract(spark: SparkSession, d: str) -> DataFrame:
    return terms(spark, d).select("doc_id", "term")


@query(f"with {_G} select * from g")
def glossary_upsert(spark: SparkSession, d: str) -> DataFrame:
    return glossary(spark, d)


@query(f"with {_G} select source, term, frequency from g where source = 'src1' and term in ('THE', 'AND', 'OF', 'Licensed', 'MIT', 'CC')")
def glossary_lookup(spark: SparkSession, d: str) -> DataFrame:
    return glossary(spark, d).where(F.col("term").isin("THE", "AND", "OF", "Licensed", "MIT", "CC") & (F.col("source") == "src1")).select("source", "term", "frequency")


@query(f"with {_G}, r as (select source, term, frequency, row_number() over (partition by source order by frequency desc, term) as place from g where contains(lower(term), 'tion')) select * from r where place <= 20")
def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("frequency").desc(), "term"))
    return glossary(spark, d).where(F.contains(F.lower("term"), F.lit("tion"))).select("source", "term", "frequency", place.alias("place")).where("place <= 20")


@query(f"with {_G}, r as (select source, term, row_number() over (partition by source order by term) as place, count(*) over (partition by source) as total from g) select source, term, total, ceil(total / 20.0)::bigint as pages from r where place between 21 and 40")
def paginate_terms(spark: SparkSession, d: str) -> DataFrame:
    """The second page (20 terms) of each source's glossary, with the totals."""
    numbered = ranked(glossary(spark, d).select("source", "term"), "source", "term").withColumnRenamed("group_rows", "total")
    return numbered.where("place between 20 and 39").select("source", "term", "total", F.ceil(F.col("total") / 20.0).alias("pages"))


@query(f"""with {_G}, q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) as key from benchmark),
m as (select lower(term) as key, sum(frequency)::bigint as frequency from g group by 1), r as (select item_id, key, frequency, row_number() over (partition by item_id order by frequency desc, key) as place from q join m using (key)) select * from r where place <= 5""")
def glossary_enrich_query(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.explode_outer(F.array_distinct(T.tokenize(F.col("text")))).alias("key"))
    merged = glossary(spark, d).groupBy(F.lower("term").alias("key")).agg(F.sum("frequency").alias("frequency"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("frequency").desc(), "key"))
    return words.join(merged, "key").select("item_id", "key", "frequency", place.alias("place")).where("place <= 5")


@query(f"""with {_G}, old as (select term, lower(term) as key, definition, frequency from g where source = 'src1'), new as (select lower(term) as key, min(term) as term from g where source = 'src2' group by 1)
select coalesce(old.key, new.key) as key, coalesce(old.term, new.term) as term, case when new.key is not null then 'given' else old.definition end as definition from old full join new on old.key = new.key""")
def glossary_add(spark: SparkSession, d: str) -> DataFrame:
    """The terms of one source put into another's glossary by their lower-cased form; the given definition wins."""
    both = glossary(spark, d).where("source in ('src1', 'src2')").withColumn("key", F.lower("term"))
    old = both.where("source = 'src1'").select("key", F.col("term").alias("old_term"), "definition")
    new = both.where("source = 'src2'").groupBy("key").agg(F.min("term").alias("new_term"))
    return old.join(new, "key", "full").select("key", F.coalesce("old_term", "new_term").alias("term"), F.when(F.col("new_term").isNotNull(), "given").otherwise(F.col("definition")).alias("definition"))


@query(f"with {_G} select source, term from g where lower(term) not in (select lower(term) from g where source = 'src3')")
def glossary_delete(spark: SparkSession, d: str) -> DataFrame:
    g = glossary(spark, d).select("source", "term", F.lower("term").alias("key"))
    return g.join(g.where("source = 'src3'").select("key").distinct(), "key", "left_anti").select("source", "term")


@query(f"""with {_G}, r as (select *, row_number() over (partition by source order by frequency desc, term) as place from g)
select source, '## Domain-Specific Terminology (Use these definitions for accuracy)' || E'\\n' || string_agg('- **' || term || '**' || case when frequency > 1 then ' [term]' else '' end || ': ' || definition, E'\\n' order by place) as prompt from r where place <= 10 group by source""")
def glossary_prompt(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("frequency").desc(), "term"))
    best = glossary(spark, d).withColumn("place", place).where("place <= 10").withColumn("category", F.when(F.col("frequency") > 1, "term"))
    ordered = best.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "term", "category", "definition"))).alias("t"))
    return ordered.select("source", G.prompt(F.col("t")).alias("prompt"))
