"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import centroids, decontaminate, kdtree, linededup, lm, merkle, packing, pii, pu, rules, sharding, simhash, warc
from foliant.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated runs: how much of it is cut, what stays, and the runs as lo-hi@source."""
    done = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("runs", lambda r: F.concat(r["lo"], F.lit("-"), r["hi"], F.lit("@"), r["source"])), ",")
    return done.select("doc_id", F.col("n_units").cast("long").alias("n_units"), F.col("removed_units").cast("long").alias("removed_units"), F.col("words_left").cast("long").alias("words_left"), runs.alias("runs"), "text")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it carries."""
    found = decontaminate.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), ","))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read(spark, sf_dir, "documents")).drop("text_hash", "n_term")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the compacted table holds it, with a digest of its text."""
    _, rows = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "n_chars", F.md5("text").alias("text_md5"))


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def op13_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"))


_ALL = (
    op1_line_dedup, op2_pu_quality, op3_spaced_seed_decontamination, op4_warc, op5_pii, op6_sharding, op7_bm25_packing, op8_quality_trees,
    op9_simhash, op10_ngram_lm, op11_merkle_manifest, op12_orchard_clusters, op13_kdtree_topk,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _merkle_sql() -> str:
    """The manifest level by level in recursive SQL, crc32 bit by bit."""
    part = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
    leaf = "sha256(concat(" + ", ".join(part.format(x) for x in ("doc_id", "source", "lang", "n_chars", "{0}")) + "))"
    bits = "flatten(list_transform(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)), lambda b: [b::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, e: case when e >= 0 then xor(c, e) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)"
    levels = """
        {0}(tree, level, place, n, h) as (
            select {1} union all
            select tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' order by place)) from {0} where n > 1 group by tree, level, place // 8, n),
        {0}_runs as (select tree, level, place // 8 as run, list(h order by place) as hs from {0} where n > 1 group by all)"""
    up = levels.format("up", "lang, 0, place, n, leaf from base")
    top = levels.format("top", "null::varchar, 0, row_number() over (order by tree nulls first) - 1, count(*) over (), h from up where n = 1")
    lower = _UPPER_SQL
    return f"""
        with recursive hashed as (select doc_id, lang, {leaf.format("text")} as leaf,
            case when xor({crc}, 4294967295) % 3 = 0 then {leaf.format(lower)} else {leaf.format("text")} end as seen from documents),
        base as (select *, row_number() over (order by lang, doc_id, leaf) as rid, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place,
            count(*) over (partition by lang) as n from hashed),
        {up}, {top},
        subroots as (select tree, h as subroot, row_number() over (order by tree nulls first) - 1 as place from up where n = 1),
        steps as (
            select rid, r.level as step, array_to_string(hs[1:i], '') as before, array_to_string(hs[i + 2:], '') as after
            from (select *, (place // (8 ** r.level)::bigint % 8)::bigint as i from base b join up_runs r on b.lang is not distinct from r.tree and r.run = place // (8 ** (r.level + 1))::bigint) r
            union all
            select rid, 1000 + r.level, array_to_string(hs[1:i], ''), array_to_string(hs[i + 2:], '')
            from (select b.rid, r.level, r.hs, (s.place // (8 ** r.level)::bigint % 8)::bigint as i from base b join subroots s on b.lang is not distinct from s.tree
                  join top_runs r on r.run = s.place // (8 ** (r.level + 1))::bigint) r),
        numbered as (select *, row_number() over (partition by rid order by step) as k from steps),
        folded(rid, k, h) as (select rid, 0, seen from base union all
            select f.rid, f.k + 1, sha256(s.before || f.h || s.after) from folded f join numbered s on s.rid = f.rid and s.k = f.k + 1),
        proofs as (select rid, sha256(string_agg(before || after, '' order by k)) as proof_sha256 from numbered group by rid)
        select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = root as verified
        from base b join subroots s on b.lang is not distinct from s.tree cross join (select h as root from top where n = 1) left join proofs p using (rid)
        join (select rid, arg_max(h, k) as h from folded group by rid) f using (rid)"""


def _clusters_sql(rounds: int = 10, k: int = 8) -> str:
    near = "select rid, any_value(v) as v, any_value(vec_id) as vec_id, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint, k := cluster)) as best from kept cross join c{0} group by rid"
    parts = [
        "kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings "
        "where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), v) - 1 as cluster, v as c from kept qualify cluster < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized ({near.format(r)})")
        parts.append(
            f"c{r + 1} as materialized (select c.cluster, coalesce(m.c, c.c) as c from c{r} c left join (select cluster, list((s - ((s % n) + n) % n) // n order by i) as c from "
            f"(select best.k as cluster, i, sum(v[i])::bigint as s, count(*) as n from a{r}, range(1, 65) t(i) group by all) group by cluster) m using (cluster))"
        )
    return f"""with {", ".join(parts[:-1])}
        select vec_id, best.k::int as cluster, best.d as distance, (sum(best.d) over (partition by best.k))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia,
               sha256(array_to_string(c, ',')) as centroid_sha256
        from a{rounds} join c{rounds} on cluster = best.k"""


_UPPER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL over the same tables. The others are tested against brute force, round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
        f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from d)
        select page_id, payload_bytes, payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
               case when first_id <> page_id then first_id end as refers_to
        from f""",
    "op6_sharding": "select doc_id, source, n_chars, md5(text) as text_md5 from documents",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_orchard_clusters": _clusters_sql(),
    "op13_kdtree_topk": """
        with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        s as (select q.rid as number, c.rid, q.vec_id as query_id, c.vec_id,
            coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
            from v q join v c on q.rid <> c.rid where q.vec_id % 20 = 0)
        select query_id, (row_number() over (partition by number order by score desc, vec_id, rid))::int as rank, vec_id, score from s qualify rank <= 20""",
}
