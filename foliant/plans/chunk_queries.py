"""Queries of ingestion and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import hooks
from foliant.functions import text as T
from foliant.operators import chunking as C
from foliant.operators.relational import first_per_key, upsert_latest
from foliant.operators.ordering import summed
from foliant.plans.registry import query
from foliant.sources import ingest
from foliant.sources.keyed import Cache, KeyedTable
from foliant.sources.tables import table

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SENT = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_WRAP = "flatten(list_transform({0}, lambda s: case when length(s) <= {1} then [s] else list_transform(range(0, length(s), {1}), lambda i: substr(s, i::int + 1, {1})) end))"
_PACK = "string_split(list_reduce({0}, lambda a, s: case when length(split_part(a, chr(2), -1)) + length(s) <= {1} then a || case when split_part(a, chr(2), -1) = '' then '' else ' ' end || s else a || chr(2) || s end), chr(2))"
_CH = f"c0 as (select doc_id, case when length(text) <= 1800 then [text] else {_PACK.format(_WRAP.format(_SENT.format('text'), 1800), 1800)} end as l from documents where text is not null), c1 as (select doc_id, list_filter(list_transform(l, lambda x: {_STRIP.format('x')}), lambda x: x <> '') as l from c0), ch as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as chunk_index from c1)"
_SHOW = "doc_id, chunk_index, length(text) as n, md5(text) as text_md5"


def _show(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.explode(table(spark, d, "documents").where("text is not null"), C.structural(F.col("text")))


@query(f"with {_CH} select {_SHOW} from ch")
def chunk_structural(spark: SparkSession, d: str) -> DataFrame:
    return _show(chunks(spark, d))


@query(f"with c0 as (select doc_id, {_PACK.format(_WRAP.format(_SENT.format('text'), 600), 600)} as l from documents), c1 as (select doc_id, list_filter(list_transform(l, lambda x: {_STRIP.format('x')}), lambda x: x <> '') as l from c0), ch as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as chunk_index from c1) select {_SHOW} from ch")
def chunk_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _show(C.explode(table(spark, d, "documents"), C.pack_sentences(F.col("text"), F.lit(0), 600)))


@query(f"with {_CH}, o as (select doc_id, chunk_index, case when lag(text) over w is null then text else right(lag(text) over w, 200) || ' ' || text end as text from ch window w as (partition by doc_id order by chunk_index)) select {_SHOW} from o")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _show(C.overlap(chunks(spark, d)))


@query()
def chunk_semantic_refine(spark: SparkSession, d: str) -> DataFrame:
    return _show(C.semantic(chunks(spark, d)))


@query()
def chunk_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return _show(C.semantic(C.overlap(chunks(spark, d))))


_MERGE = "string_split(list_reduce({0}, lambda a, s: case when length(s) < 900 or length(split_part(a, chr(2), -1)) < 900 then a || ' ' || s else a || chr(2) || s end), chr(2))"


@query(f"with {_CH.replace('1800', '700')}, g as (select doc_id, list(text order by chunk_index) as l from ch group by doc_id), m as (select doc_id, {_MERGE.format('l')} as l from g), x as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as chunk_index from m) select {_SHOW} from x")
def chunk_merge_short(spark: SparkSession, d: str) -> DataFrame:
    small = C.structural(F.col("text"), 700)
    return _show(C.explode(table(spark, d, "documents").where("text is not null"), C.merge_short(small)))


_LASTF = "case when contains({0}, '{1}') then {2} - position('{1}' in reverse({0})) else -1 end"


@query(f"""with recursive t as (select doc_id, {_STRIP.format('text')} as t from documents), p as (select doc_id, 0 as pos, 0 as k from t where length(t) > 0
union all select doc_id, (case when pos + 512 < n and stop > 256 then pos + stop + 1 else pos + 512 end - 50)::int, k + 1 from (select p.doc_id, p.pos, p.k, length(t.t) as n,
  greatest({_LASTF.format('substr(t.t, p.pos + 1, 512)', '.', 512)}, case when contains(substr(t.t, p.pos + 1, 512), chr(10)) then 512 - position(chr(10) in reverse(substr(t.t, p.pos + 1, 512))) else -1 end) as stop from p join t using (doc_id)) x
where (case when pos + 512 < n and stop > 256 then pos + stop + 1 else pos + 512 end - 50) < n),
e as (select doc_id, pos, coalesce(lead(pos) over (partition by doc_id order by k) + 50, 1000000000) as fin from p),
x as (select e.doc_id, pos, {_STRIP.format('substr(t.t, pos + 1, least(fin - pos, 512)::int)')} as text from e join t using (doc_id))
select doc_id, row_number() over (partition by doc_id order by pos) - 1 as chunk_index, length(text) as n, md5(text) as text_md5 from x where text <> ''""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _show(C.explode(table(spark, d, "documents"), C.fixed(F.col("text"))))


_WIN = f"""with recursive p as (select doc_id, 0 as pos, 0 as k from documents where length(text) > 0
union all select doc_id, fin, k + 1 from (select p.doc_id, p.k, length(t.text) as n, case when pos + 6000 >= length(t.text) then length(t.text)
  when contains(substr(t.text, pos + 1, 6002), '. ') and length(substr(t.text, pos + 1, 6002)) - position(' .' in reverse(substr(t.text, pos + 1, 6002))) - 1 > 4200 then pos + length(substr(t.text, pos + 1, 6002)) - position(' .' in reverse(substr(t.text, pos + 1, 6002)))
  else pos + 6000 end::int as fin from p join documents t using (doc_id)) x where fin < n),
e as (select doc_id, pos, k, lead(pos) over (partition by doc_id order by k) as fin from p),
x as (select e.doc_id, pos, {_STRIP.format("substr(t.text, pos + 1, coalesce(fin - pos, length(t.text))::int)")} as text from e join documents t using (doc_id)),
w as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as chunk_index, text from x where length(text) >= 40)"""


@query(f"{_WIN} select {_SHOW} from w")
def extraction_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode_outer(C.windows(F.col("text"))).alias("chunk_index", "text")).where("text is not null")
    return _show(rows)


@query(f"{_WIN}, n as (select doc_id, count(*) as n from w group by doc_id) select w.doc_id, chunk_index, md5(text) as text_md5 from w join n using (doc_id) where n.n <= 2 or chunk_index in (0, n.n // 2)")
def sample_windows(spark: SparkSession, d: str) -> DataFrame:
    """At most two windows of each document, evenly spaced."""
    whole = C.windows(F.col("text"))
    tagged = F.transform(whole, lambda w, i: F.struct(i.alias("chunk_index"), w.alias("text")))
    return table(spark, d, "documents").select("doc_id", F.explode_outer(C.sample(tagged, 2)).alias("w")).where("w is not null").select("doc_id", "w.chunk_index", F.md5("w.text").alias("text_md5"))


@query(f"with {_CH}, n as (select doc_id, count(*) as n, avg(length(text)) as a from ch group by doc_id) select source, sum(n)::bigint as chunks, round(avg(a), 3) as mean_chars from n join documents using (doc_id) group by source")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    each = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("a"))
    return each.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("n").alias("chunks"), F.round(F.avg("a"), 3).alias("mean_chars"))


@query(r"with s as (select doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '([.!?…])( |$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') as l from documents) select doc_id, len(l)::int as sentences, list_max(list_transform(l, lambda x: length(x)))::int as longest from s")
def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split(T.squeeze(F.col("text")), r"(?<=[.!?…])(?= |$)"), lambda s: s != "")
    return table(spark, d, "documents").select("doc_id", parts.alias("l")).select("doc_id", F.size("l").alias("sentences"), F.array_max(F.transform("l", F.length)).alias("longest"))


@query("with s as (select conv_id, turn, text, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start from conversations) select conv_id, turn, start, start + length(text) as fin from s")
def book_assembly_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Turns as sections of one book: where each begins and ends in the text joined by line feeds."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n")).withColumn("room", F.col("n") + 1)
    return summed(turns, "conv_id", "room", "turn").select("conv_id", "turn", F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("fin"))


@query("with s as (select conv_id, turn, sum(length(text) + 1) over (partition by conv_id order by turn) - length(text) - 1 as start, text from conversations), b as (select conv_id, string_agg(text, E'\\n' order by turn) as book from conversations group by conv_id) select conv_id, turn from s join b using (conv_id) where substr(book, start::int + 1, length(text)) <> text")
def offset_check(spark: SparkSession, d: str) -> DataFrame:
    """Sections that don't stand at their offset in the joined book: none may be left."""
    c = table(spark, d, "conversations")
    book = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("book"))
    placed = book_assembly_offsets(spark, d).join(c, ["conv_id", "turn"]).join(book, "conv_id")
    return placed.where(F.expr("substring(book, cast(start as int) + 1, length(text)) != text")).select("conv_id", "turn")


@query("with d as (select count(*) as n, count(text) as texts, sum(length(text))::bigint as chars from documents) select * from d")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


#: Fixed values, for the check only: what stands for tags, entities and white space, as a chain in SQL.
_HTML = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html), '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'),
 '(?i)</(p|div|h[1-6]|li|blockquote|section|tr)>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""


@query(f"select page_id, length(x) as n, md5(x) as text_md5 from (select page_id, {_STRIP.format(_HTML).replace('{{', '{').replace('}}', '}')} as x from pages)")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pages").select("page_id", ingest.html_to_text(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").alias("n"), F.md5("x").alias("text_md5"))


@query(f"with t as (select regexp_extract(url, '^https?://([^/]+)', 1) as host, page_id, {_STRIP.format(_HTML).replace('{{', '{').replace('}}', '}')} as x from pages) select host, count(*) as chapters, md5(string_agg(x, E'\\n\\n' order by page_id)) as book_md5 from t where x <> '' group by host")
def html_chapters_concat(spark: SparkSession, d: str) -> DataFrame:
    """The pages of a host as chapters of one book, in order."""
    t = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id", ingest.html_to_text(F.col("html")).alias("x")).where("x != ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda s: s["x"])
    return t.groupBy("host").agg(F.count("*").alias("chapters"), F.md5(F.array_join(ordered, "\n\n")).alias("book_md5"))


@query("select doc_id, greatest(1, ceil(length(text) / 3000.0))::bigint as pages, (greatest(1, ceil(length(text) / 3000.0))::bigint - 1) * 3000 as last_boundary from documents")
def synthetic_paging(spark: SparkSession, d: str) -> DataFrame:
    bounds = ingest.page_boundaries(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(bounds).cast("long").alias("pages"), F.element_at(bounds, -1).cast("long").alias("last_boundary"))


@query("with p as (select doc_id, unnest(range(0, greatest(1, length(text)), 3000)) as s, text from documents) select doc_id, s // 3000 as page, md5(substr(text, s::int + 1, 3000)) as page_md5 from p")
def page_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(ingest.page_slices(F.col("text"))).alias("page", "t")).select("doc_id", "page", F.md5("t").alias("page_md5"))


@query("select conv_id, turn, coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as boundary from conversations")
def page_concat_boundaries(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).alias("boundary"))


@query("select doc_id, (doc_id * 37) % (n_chars + 1) as place, 1 + least((doc_id * 37) % (n_chars + 1), greatest(1, ceil(n_chars / 3000.0)) * 3000 - 1)::bigint // 3000 as page from documents")
def offset_to_page(spark: SparkSession, d: str) -> DataFrame:
    place = (F.col("doc_id") * 37) % (F.col("n_chars") + 1)
    return table(spark, d, "documents").select("doc_id", place.alias("place"), ingest.offset_to_page(place, ingest.page_boundaries(F.col("text"))).alias("page"))


@query("select source, count(*) filter (length(trim(text)) > 0) as ready, count(*) filter (not length(trim(text)) > 0 or text is null) as failed, count(*) filter (length(trim(text)) < 20) as needs_ocr from documents group by source")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("source", *ingest.status(F.col("text")))
    return s.groupBy("source").agg(F.count(F.when(F.col("status") == "READY", 1)).alias("ready"), F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"), F.count(F.when(F.col("needs_ocr"), 1)).alias("needs_ocr"))


@query("with u as (select vec_id, label, 0 as v from embeddings union all select vec_id, label + 100, 1 from embeddings where vec_id % 3 = 0 union all select vec_id + 1000000, label, 1 from embeddings where vec_id % 5 = 0), r as (select *, row_number() over (partition by vec_id order by v desc) as k from u) select vec_id, label from r where k = 1")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection after three deliveries: all points, changed and new ones, and the second again."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    points = KeyedTable(spark, ingest.scratch(spark, "points"), "vec_id", "vec_id long, label int")
    points.replace(rows, ("load", 1))
    changed = rows.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    new = rows.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    for _ in range(2):
        points.replace(changed.unionByName(new), ("load", 2))
    return points.read()


@query("select vec_id, label from embeddings where vec_id not in (select doc_id from labels where quality = 0)")
def vector_delete_by_document(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id", "label")


@query("select vec_id, label from embeddings where label <> 3")
def vector_delete_by_workspace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label != 3").select("vec_id", "label")


@query("select label, count(*) as points, count(embedding) as vectors from embeddings group by label")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("points"), F.count("embedding").alias("vectors"))


@query("with h as (select doc_id, sha1('model' || E'\\n' || text) as key from documents), c as (select distinct key from h where doc_id % 2 = 0) select key, min(doc_id) as first_doc, count(*) as n from h where key not in (select key from c) group by key")
def content_hash_cache(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the second of two calls still has to compute, once each; the first call has stored those of even ids."""
    h = table(spark, d, "documents").select("doc_id", F.sha1(F.concat_ws("\n", F.lit("model"), "text").cast("binary")).alias("key"), F.length("text").alias("value"))
    store = ingest.scratch(spark, "cache")
    first = Cache(spark, store, "key string, value int")
    first.append(first.misses(h.where("doc_id % 2 = 0")).dropDuplicates(["key"]))
    return Cache(spark, store, "key string, value int").misses(h).groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(f"with {_CH}, k as (select doc_id, max(length(text)) as m from ch group by doc_id) select {_SHOW} from ch join k using (doc_id) where m > 0")
def chunk_sink_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by source, the folders of a second delivery replaced, and read again."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text")
    return _show(ingest.replace_chunks(docs))


@query(r"""with w as (select doc_id, regexp_extract_all(text, '[A-ZÀ-Þ][\p{L}\p{N}_]{3,}') as l from documents where length(text) >= 50), p as (select doc_id, l, unnest(range(1, len(l))) as i from w)
select doc_id, l[i] as subject, 'related_to' as relation, l[i + 1] as object, 0.8::double as confidence from p""")
def triplet_extract(spark: SparkSession, d: str) -> DataFrame:
    """Triplets of whole texts of 50 characters or more, by the supplied extractor (the default one here)."""
    texts = table(spark, d, "documents").where("length(text) >= 50").select("doc_id", F.col("text").alias("prompt"))
    answers = hooks.llm_map(texts, "prompt", hooks.capitalised_pairs)
    return answers.select("doc_id", F.explode_outer(T.parse_triplets(F.col("answer"))).alias("t")).where("t is not null").select("doc_id", "t.subject", "t.relation", "t.object", "t.confidence")


@query("select doc_id, 'echo: ' || text as answer, null::varchar as error from documents")
def llm_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return hooks.llm_map(rows, "prompt", "echo: {}".format).select("doc_id", "answer", "error")


@query()
def embedding_hook(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", hooks.hashed_bag(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dimensions"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 3).alias("norm"))


_FILES = f"""with f as (select page_id, case when page_id % 7 = 3 then 'pdf' when page_id % 2 = 0 then 'html' else 'txt' end as format, page_id % 5 as part, coalesce(html, '') || E'\\n' as html from pages),
k as (select *, case format when 'pdf' then 'container' when 'html' then 'html' else 'text' end as kind,
    case when format = 'pdf' then 'no decoder for this kind' when part = 1 then 'binary' when part = 2 then 'not UTF-8' when part = 3 then 'no text' end as why from f),
t as (select *, case when why is null and kind = 'html' then length({_STRIP.format(_HTML).replace("{{", "{").replace("}}", "}")}) when why is null then length(html) end as n_chars from k)"""


@query(f"{_FILES} select kind, case when why is null then 'READY' else 'FAILED' end as status, why, count(*) as files, coalesce(sum(n_chars), 0)::bigint as n_chars from t group by all")
def ingest_binary_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as files, some with NUL bytes, broken UTF-8, nothing in them or of a kind without decoder; read and told apart."""
    pages = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    kind = F.when(F.col("page_id") % 7 == 3, "pdf").when(F.col("page_id") % 2 == 0, "html").otherwise("txt")
    part = F.col("page_id") % 5
    broken = F.when(part == 1, F.concat("html", F.lit(b"a\x00b"))).when(part == 2, F.concat("html", F.lit(b"\xc3\x28"))).when(part == 3, F.lit(b"")).otherwise(F.col("html"))
    path = ingest.scratch(spark, "files")
    ingest.write_files(pages.select(kind.alias("format"), broken.alias("content")), path)
    found = ingest.read_files(spark, path)
    return found.groupBy("kind", "status", "why").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("status") == "READY", F.length("text"))), F.lit(0)).alias("n_chars"))


@query("select event_id, user_id, event_type, json_extract(props, '$.k')::int as k from events")
def read_jsonl_cache(spark: SparkSession, d: str) -> DataFrame:
    """The events written as JSON lines and read with a declared schema."""
    path = ingest.scratch(spark, "jsonl")
    ingest.write_result(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), path)
    back = spark.read.schema("event_id long, user_id long, event_type string, props string").json(path)
    return back.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select conv_id, count(*) as turns, count(*) filter (contains(text, E'\\n')) as with_breaks from conversations group by conv_id")
def read_dialogue_csv(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues written as quoted CSV whose second field is JSON with line feeds, and read again."""
    path = ingest.scratch(spark, "csv")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(turns).alias("turns")).write.mode("overwrite").option("escape", '"').option("quoteAll", True).csv(path)
    back = ingest.read_dialogues(spark, path)
    return back.select("conv_id", F.explode("turns").alias("t")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.contains("t.text", F.lit("\n")), 1)).alias("with_breaks"))


@query("select doc_id, quality, toxic from labels")
def read_json_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Labels as JSON arrays of a few hundred items, read with a declared schema: one row for each item."""
    path = ingest.scratch(spark, "json")
    labels = table(spark, d, "labels")
    parts = max(1, labels.count() // 500)
    labels.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts))).agg(F.to_json(F.collect_list(F.struct("doc_id", "quality", "toxic"))).alias("value")).select("value").write.mode("overwrite").text(path)
    return ingest.read_json_dataset(spark, path, "doc_id long, quality int, toxic int", lines=True)


@query("select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by all")
def write_result(spark: SparkSession, d: str) -> DataFrame:
    """A result written as JSON and read back."""
    path = ingest.scratch(spark, "result")
    ingest.write_result(table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("source string, lang string, n long, chars long").json(path)
