"""Keyed tables, caches, linking, bursts and leaks: small cases with known results, and the cases that could break them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation as E
from foliant.operators import linking, ordering
from foliant.sources.keyed import Cache, KeyedTable
from foliant.streaming import jobs as J
from foliant.streaming import streams as S


def pairs(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# Keyed tables


def test_a_delivery_replaces_its_keys_once(spark, tmp_path):
    points = KeyedTable(spark, f"file://{tmp_path}/t", "k", "k long, v string", buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert points.read().count() == 0
    points.replace(rows((1, "a"), (1, "b"), (2, "c"), (None, "n"), (40, "z")), ("load", 1))
    before = points.versions.last()[1]["folders"]
    points.replace(rows((1, "new"), (None, "m")), ("load", 2))
    assert pairs(points.read()) == sorted([(1, "new"), (2, "c"), (None, "m"), (40, "z")], key=repr)
    after = points.versions.last()[1]["folders"]
    assert sum(before[b] != after[b] for b in before) <= 2 and any(before[b] == after[b] for b in before)
    version = points.versions.last()[0]
    assert points.replace(rows((1, "again")), ("load", 2)) == version and points.replace(rows((1, "late")), ("load", 1)) == version
    points.replace(rows((7, "other source")), ("other", 1))
    points.remove(rows((2, None), (99, None)).select("k"))
    assert pairs(points.read()) == sorted([(1, "new"), (None, "m"), (40, "z"), (7, "other source")], key=repr)
    points.replace(rows(), ("load", 3), keys=rows((1, None)))
    assert 1 not in {r.k for r in points.read().collect()}
    points.remove(points.read())
    assert points.read().count() == 0


def test_a_cache_is_read_by_the_next_call(spark, tmp_path):
    make = lambda: Cache(spark, f"file://{tmp_path}/c", "key string, value int")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value int")
    first = make()
    assert first.misses(rows).count() == 3
    first.append(first.misses(rows.where("value < 3")))
    assert pairs(make().misses(rows)) == [("c", 3)]
    make().append(rows)  # a and b stand twice
    assert make().misses(rows).count() == 0 and pairs(make().read()) == [("a", 1), ("b", 2), ("c", 3)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    chunks = S.ChunkSink(spark, f"file://{tmp_path}/chunks")
    docs = spark.createDataFrame([(1, "One sentence. " * 300), (2, "Two."), (None, "no id"), (3, None)], "doc_id long, text string")
    sink = chunks.sink("docs")
    sink(docs, 0)
    once = pairs(chunks.table.read())
    sink(docs, 0)
    assert pairs(chunks.table.read()) == once and {r[0] for r in once} == {1, 2}
    sink(spark.createDataFrame([(1, "Short now."), (2, None)], "doc_id long, text string"), 1)
    assert [(r[0], r[2]) for r in pairs(chunks.table.read())] == [(1, "Short now.")]


# Linking


def brute_links(queries, names):
    spaced = lambda words: f" {' '.join(words)} "
    tokens = lambda x: re.findall(r"[^\W_]+", x.lower())
    out = []
    for q, text in queries:
        asked, linked = tokens(text), []
        for name in names:
            if len(name) < 3 or name.isdigit() or not tokens(name):
                continue
            long = sorted({w for w in tokens(name) if len(w) >= 2})
            if spaced(tokens(name)) in spaced(asked):
                linked.append((1.0, name))
            elif len(long) >= 2 and len(set(long) & set(asked)) / len(long) >= 0.6:
                linked.append((round(0.8 * (len(set(long) & set(asked)) / len(long)), 6), name))
        kept = []
        for score, name in sorted(linked, key=lambda x: (-x[0], -len(x[1]), x[1])):
            if len(kept) < 5 and not any(spaced(tokens(name)) in spaced(tokens(k)) for _, k in kept):
                kept.append((score, name))
        out += [(q, name, score, place) for place, (score, name) in enumerate(kept, 1)]
    return sorted(out)


def test_names_are_linked_as_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "iron", "man", "robert", "downey", "jr", "x", "2", "fox", "river", "bank", "new", "york"]
    names = sorted({" ".join(rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(80)} | {"1234", "ab", "!!!", "Iron Man", "the iron man"})
    queries = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for k in range(60)] + [(90, ""), (91, "?"), (92, "Iron Man, iron man!")]
    linked = linking.linked_names(spark.createDataFrame(queries, "query long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    got = linking.most_specific(linked.withColumn("score", F.round("score", 6)))
    assert sorted((r["query"], r["name"], r["score"], r["place"]) for r in got.collect()) == brute_links(queries, names)


def test_substrings_are_found_in_any_case(spark):
    names = ["Robert Downey", "downtown", "RODEO", "a", "", "Ünïcode", "aXb"]
    index = linking.substring_index(spark.createDataFrame([(n,) for n in names], "name string"))
    parts = ["down", "own", "o", "de", "ünï", "x", "zzz", "robert downey jr", ""]
    got = linking.names_holding(spark.createDataFrame([(p,) for p in parts], "part string"), index)
    assert pairs(got) == sorted(((p, n) for p in parts if p for n in names if p in n.lower()), key=repr)


def test_an_expansion_is_cut_to_its_edges_and_goes_on_from_their_ends(spark):
    edges = [(f"hub {k:03}", f"leaf {k:03}", k) for k in range(80)] + [("leaf 003", "far", 900), ("leaf 070", "never", 901)]
    frame = spark.createDataFrame(edges, "src string, dst string, rel_id long")
    got = linking.expand_by_substring(frame, spark.createDataFrame([(1, "HUB"), (2, "nothing")], "query long, part string"), depth=2, most=50).collect()
    first = {r.rel_id for r in got if r.depth == 1}
    assert first == set(range(50)) and {r.rel_id for r in got if r.depth == 2} == {900} and {r["query"] for r in got} == {1}


# Bursts, sums, leaks


def brute_bursts(times, seconds):
    out, started = [], None
    for t in sorted(times):
        if started is None or t >= started + seconds:
            started = t
            out.append([t, 0])
        out[-1][1] += 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("folded", [0, 1 << 30])
def test_bursts_of_one_key_of_many_messages(spark, folded, monkeypatch):
    monkeypatch.setattr(J, "FOLDED", folded)
    rng = random.Random(1)
    gaps = [rng.choice((0, 1, 7, 60, 119, 120, 121, 400)) for _ in range(900)]
    times, at = [], 1_000
    for g in gaps:
        at += g
        times.append(at)
    rows = [("hot", t) for t in times] + [("one", 5), (None, 7), (None, 8), ("same", 9), ("same", 9)]
    events = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = J.burst_groups(events, "k").select("k", "burst", F.unix_seconds(F.col("started").cast("timestamp")).alias("s"), "n").collect()
    for key in ("hot", "one", None, "same"):
        mine = [(r.s, r.n) for r in sorted((r for r in got if r.k == key), key=lambda r: r.burst)]
        assert mine == brute_bursts([t for k, t in rows if k == key], 120)


def test_bursts_of_a_million_messages(spark):
    """Every 100 seconds: each burst has two messages, so a chain of half a million beginnings is followed in 20 rounds."""
    events = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 100).alias("ts"))
    n = J.burst_groups(events, "k").agg(F.count("*"), F.min("n"), F.max("n"), F.max("burst")).first()
    assert tuple(n) == (500_000, 2, 2, 499_999)


def test_sums_and_following_values_equal_windows(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("w"))
    got = ordering.summed(rows, "g", "v", "o")
    want = rows.selectExpr("*", "coalesce(sum(v) over (partition by g order by o rows between unbounded preceding and 1 preceding), 0L) as before")
    assert got.exceptAll(want).count() == 0 and got.count() == 2000
    got = ordering.following(rows, "g", "w", "o")
    want = rows.selectExpr("*", "first(w) ignore nulls over (partition by g order by o rows between current row and unbounded following) as next")
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


def test_leaks_are_dropped_until_none_is_left(spark):
    """Item 0's answer stands in item 1's text; with 0 gone the groups change, and 3 leaks where it didn't before."""
    rows = [(0, "zero text", "one"), (1, "one text", "none"), (2, "two alpha", "beta"), (3, "three text", "alpha"), (4, "four text", ""), (5, None, None), (6, "six", "never")]
    items = spark.createDataFrame(rows, "item long, text string, answer string")

    def brute(most):
        gone = set()
        while True:
            chosen = [r for r in rows if r[0] not in gone][:most]
            leaking = {q[0] for k, q in enumerate(chosen) if q[2] and any(v[1] and q[2] in v[1] for j, v in enumerate(chosen) if j % 2 != k % 2)}
            if not leaking:
                return [(r[0], k) for k, r in enumerate(chosen)]
            gone |= leaking

    for share, most in ((0.55, 4), (1.0, 7)):
        assert pairs(E.leak_free(items, share)) == brute(most)
    assert E.leak_free(items.limit(0), 0.5).count() == 0


@pytest.mark.parametrize(("said", "found", "want"), [(["Ann Lee", "Bob"], ["bob", "x", "Lee"], (2, 2, 1, 0)), (["Ann", "Bob"], ["Bob K", "Ann (the first)"], (2, 2, 1, 1)), (["Ann"], [], (1, 0, 0, 0))])
def test_recall_of_a_dialogue(spark, said, found, want):
    turns = spark.createDataFrame([(1, True, said), (1, False, found), (2, False, ["Only reply"])], "conv_id long, asked boolean, l array<string>")
    assert pairs(E.graph_recall(turns)) == [(1, *want)]


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from foliant.streaming import streams as S

    rows = spark.range(6).selectExpr("id as doc_id", "'a' as text", "'en' as lang", "'s' as source", "1L as n_chars")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for layout in ("one", "many"):
        got = S.drain(S.table_stream(spark, f"{tmp_path}/{layout}", "documents"), "append")
        assert sorted(r.doc_id for r in got.collect()) == list(range(6))


def test_the_first_neighbour_of_equal_relations_is_the_least(spark, tmp_path):
    """Which of them comes first must not depend on partitions; the SQL leaves it open."""
    from foliant.plans.graph_queries import entity_detail

    for name, rows in {"lineitem": "l_partkey int, l_suppkey int, l_returnflag string, l_orderkey long, l_linenumber int", "part": "p_partkey int, p_name string", "supplier": "s_suppkey int, s_name string"}.items():
        data = {"lineitem": [(9, 0, "A", 1, 1), (1, 0, "R", 1, 1), (5, 0, "N", 1, 1)], "part": [(1, "a"), (5, "b"), (9, "c")], "supplier": [(0, "s")]}[name]
        spark.createDataFrame(data, rows).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r.node: r.first_other for r in entity_detail(spark, str(tmp_path)).collect()}
    assert found == {"s0": "p1", "p1": "s0", "p5": "s0", "p9": "s0"}


def test_queries_with_the_same_texts_are_linked_once(spark, monkeypatch):
    names = spark.createDataFrame([("red bolt",), ("red bolt brand",), ("blue ring",)], "name string")
    texts = ["Has the red bolt brand come?", "Where is the blue ring?", "Nothing here"]
    rows = [(q, texts[q % 3]) for q in range(60)] + [(60, None), (61, texts[0]), (61, texts[1])]
    asked, linked = [], linking.linked_names
    monkeypatch.setattr(linking, "linked_names", lambda queries, names: asked.append(queries.count()) or linked(queries, names))
    got = sorted((r["query"], r["place"], r["name"], r["score"]) for r in linking.linked_entities(spark.createDataFrame(rows, "query long, text string"), names).collect())
    assert asked == [5]  # three texts, and the pair of query 61
    one = {0: [(1, "red bolt brand", 1.0)], 1: [(1, "blue ring", 1.0)], 2: []}
    want = [(q, *x) for q in range(60) for x in one[q % 3]] + [(61, 1, "red bolt brand", 1.0), (61, 2, "blue ring", 1.0)]
    assert got == want
