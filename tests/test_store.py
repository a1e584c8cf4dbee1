"""Stored tables: refreshed for changed rows only, read by versions; and BM25 over them against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.operators import ordering
from foliant.operators import retrieval as R
from foliant.plans import catalogue, evaluation_queries, retrieval_queries
from foliant.sources import store
from foliant.sources.versions import VersionConflict, Versions

DOCS = "key long, text string"


def brute(docs, queries, k):
    """docs: {key: text}; the documents' ranks of each query by the scoring rule itself."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    n, average = len(docs), max(1, sum(map(len, words.values()))) / max(1, len(docs))
    df = Counter(w for x in words.values() for w in set(x))
    out = []
    for q, text in queries:
        scores = []
        for i, x in words.items():
            tf = Counter(x)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / average)) for w in set(re.findall(r"[^\W_]+", text.lower())) if tf[w])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        out += [(q, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def texts(rng, n):
    """Words of very unequal frequency, so that bounds have something to prune."""
    return {k: " ".join(f"w{int(1.35 ** rng.randrange(24))}" for _ in range(rng.randrange(0, 60))) for k in range(n)}


def test_bm25_equals_brute_force_through_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R.Bm25Index, "BLOCK_DOCS", 40)
    rng = random.Random(4)
    docs = texts(rng, 150) | {900: None, 901: "", 902: "W1 w1 W1", 903: "lone"}
    queries = [(q, " ".join(f"w{int(1.35 ** rng.randrange(26))}" for _ in range(rng.randrange(1, 9)))) for q in range(15)] + [(90, "lone w1"), (91, ""), (92, "unheard"), (93, "w1 w2 w3 lone")]
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")

    def refresh():
        return index.refresh(spark.createDataFrame([*docs.items(), (None, "no key")], DOCS))

    def found(k):
        return sorted((r["query"], r["id"], r["rank"]) for r in index.search(spark.createDataFrame(queries, "query long, text string"), k).collect())

    assert refresh()["derived"] == len(docs)
    for k in (1, 5):
        assert found(k) == brute(docs, queries, k)
    docs |= {3: "w1 lone lone", 4: "changed words only", 950: "new w9 lone"}
    del docs[7]
    manifest = refresh()
    assert (manifest["derived"], manifest["dropped"]) == (3, 3)
    assert found(5) == brute(docs, queries, 5)
    for step in range(store.MOST_SEGMENTS):
        docs[5] = f"step{step} w3"
        manifest = refresh()
    assert len(manifest["segments"]) < store.MOST_SEGMENTS
    assert found(5) == brute(docs, queries, 5)


def test_an_unchanged_source_derives_nothing(spark, tmp_path):
    calls = []

    def derive(rows):
        calls.append(1)
        return rows.select("key", F.length("text").alias("n"))

    table = store.DerivedTable(spark, f"file://{tmp_path}/t", derive)
    docs = spark.createDataFrame([(1, "a"), (1, "bb"), (2, None), (3, "c"), (3, "c")], DOCS)
    first = table.refresh(docs)
    assert table.refresh(docs.orderBy(F.col("key").desc())) == first and len(calls) == 1
    assert sorted((r["key"], r["n"]) for r in table.read().where("n is not null").collect()) == [(1, 1), (1, 2), (3, 1), (3, 1)]
    table.refresh(docs.where("text is null or text != 'c'").unionByName(spark.createDataFrame([(3, "c")], DOCS)))
    assert len(calls) == 2 and table.read().where("key = 3").count() == 1
    assert table.refresh(docs.where("key > 5"))["dropped"] == 3
    assert table.read().count() == 0


def test_a_search_of_an_unchanged_corpus_tokenises_queries_only(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} common") for k in range(50)], DOCS)
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")
    index.refresh(docs)
    calls = []
    index.table.derive = lambda rows: calls.append(1)
    index.refresh(docs)
    assert not calls
    plan = index.search(spark.createDataFrame([(1, "word7")], "query long, text string"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_bounds_keep_weak_documents_out(spark, tmp_path):
    """A word of every document can't bring one in; only documents with a rare word are scored."""
    docs = spark.createDataFrame([(k, "common " * (1 + k % 3) + ("rare rare rare" if k < 12 else f"other{k}")) for k in range(600)], DOCS)
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")
    index.refresh(docs)
    seen = []
    entries = index.entries
    index.entries = lambda blocks: seen.append(entries(blocks)) or seen[-1]
    top = index.search(spark.createDataFrame([(1, "rare common")], "query long, text string"), 5)
    assert {r["id"] for r in top.collect()} <= set(range(12))
    opened = [r.asDict() for r in seen[2].select("term", "id").collect()]  # first the lead's entries, then those scored, then those opened by bounds
    assert {x["term"] for x in opened} <= {"rare"} and len(opened) <= 12


def test_versions_never_replace(spark, tmp_path):
    one, two = Versions(spark, f"file://{tmp_path}/v"), Versions(spark, f"file://{tmp_path}/v")
    assert one.last() == (0, {})
    assert one.commit({"a": 1}, 0) == 1
    with pytest.raises(VersionConflict):
        two.commit({"a": 2}, 0)
    assert two.last() == (1, {"a": 1})


def test_places_equal_a_window(spark):
    rows = spark.range(3000).select((F.col("id") % 5).alias("k"), F.when(F.col("id") % 7 > 0, F.lit("g")).alias("grp"), "id")
    got = ordering.ranked(rows, "grp", "k", "id")
    want = rows.selectExpr("k", "grp", "id", "row_number() over (partition by grp order by k, id) - 1L as place", "count(*) over (partition by grp) as group_rows")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 3000
    same = ordering.ranked(spark.range(500).select(F.lit(1).alias("grp"), F.lit("x").alias("v")), "grp", "v")
    assert sorted(r["place"] for r in same.collect()) == list(range(500))
    assert ordering.ranked(rows.limit(0), "grp", "id").count() == 0


def test_an_index_is_built_without_a_shuffle_of_postings(spark):
    """Terms are counted inside rows and postings packed inside tasks; only keys that repeat are gathered."""
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], DOCS)
    terms = R.Bm25Index._terms(docs)
    assert "Aggregate" not in plan(terms)
    assert sorted((r.key, r.length, [tuple(x) for x in r.terms]) for r in terms.collect()) == [(1, 3, [("a", 1), ("b", 2)]), (2, 0, []), (3, 0, [])]
    blocks = R.Bm25Index._blocks(terms)
    assert "Aggregate" not in plan(blocks) and "Generate" not in plan(blocks)
    assert sorted((r.term, r.n, r.most, r.least, r.id, r.tf, r.length) for r in blocks.collect()) == [("a", 1, 1, 3, [1], [1], [3]), ("b", 1, 2, 3, [1], [2], [3])]
    again = R.Bm25Index._terms(docs.unionByName(spark.createDataFrame([(1, "b c")], DOCS)))
    assert {(r.key, r.length, frozenset(tuple(x) for x in r.terms)) for r in again.collect()} == {(1, 5, frozenset({("a", 1), ("b", 3), ("c", 1)})), (2, 0, frozenset()), (3, 0, frozenset())}


def test_index_blocks_are_written_as_they_come(spark, tmp_path, monkeypatch):
    """No task sorts its blocks, for folders neither; each batch is in the order of its terms, and few terms are looked up by name."""
    monkeypatch.setattr(R.Bm25Index, "BLOCK_DOCS", 40)
    docs = spark.createDataFrame([*texts(random.Random(3), 150).items(), (900, "\U0001f600 \uff5a z \u00e9 a"), (901, None)], DOCS)
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")
    assert "Sort" not in R.Bm25Index._blocks(index._terms(docs))._jdf.queryExecution().optimizedPlan().toString()
    folder = Path(index.refresh(docs)["segments"][0]["folder"].removeprefix("file://")) / "index"
    assert not [f for f in folder.iterdir() if f.is_dir()]
    batches = {}
    for file in sorted(folder.glob("*.parquet")):
        for r in spark.read.parquet(f"file://{file}").select("batch", "term").collect():
            batches.setdefault(r["batch"], []).append(r["term"].encode())
    assert len(batches) > 3 and all(terms == sorted(terms) for terms in batches.values())
    for most in (R.MOST_NAMED, 0):
        monkeypatch.setattr(R, "MOST_NAMED", most)
        found = index.blocks(spark.createDataFrame([("z",), ("\u00e9",), ("w1",), ("unheard",)], "term string"))
        assert sorted(r["term"] for r in found.select("term").distinct().collect()) == ["w1", "z", "\u00e9"]
        assert ("In(term" in found._jdf.queryExecution().executedPlan().toString()) == (most > 0)


def test_queries_and_vectors_both_go_to_shares(spark):
    """No task holds all queries: each group has a share of them and a block of the vectors."""
    rng = random.Random(2)
    rows = [(k, None, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    queries = spark.createDataFrame(rows, "query long, scope int, embedding array<double>")
    vectors = spark.createDataFrame(rows, "id long, scope int, embedding array<double>")
    found = R.dense_topk(queries, vectors, 5, block_rows=8)
    assert "share" in found._jdf.queryExecution().optimizedPlan().toString()
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 6)  # noqa: B905, E731
    want = {(q, i, rank) for q, _, a in rows for rank, (_, i) in enumerate(sorted((-cosine(a, b), i) for i, _, b in rows)[:5], 1)}
    assert {(r["query"], r["id"], r["rank"]) for r in found.collect()} == want


def test_groups_of_documents_score_as_bounds_do(spark, tmp_path, monkeypatch):
    """Many groups and shares, terms of many documents and of few, ties, and documents that have changed; pairs of query and document aren't shuffled."""
    for name, value in {"MOST_OPENED": -1, "GROUP_POSTINGS": 500, "SHARE_TERMS": 20, "CELLS": 100, "MOST_DENSE": 3}.items():
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr(R.Bm25Index, "BLOCK_DOCS", 10)
    rng = random.Random(7)
    docs = texts(rng, 150) | {900: None, 901: "", 903: "lone", 904: "lone"}
    queries = [(q, " ".join(f"w{int(1.35 ** rng.randrange(26))}" for _ in range(rng.randrange(1, 30)))) for q in range(15)] + [(90, "lone w1"), (91, ""), (92, "unheard")]
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")
    asked = spark.createDataFrame(queries, "query long, text string")
    for step in range(2):
        index.refresh(spark.createDataFrame([*docs.items()], DOCS))
        for most in (store.MOST_KEYS, 0):  # few queries by their bounds first; many at once
            monkeypatch.setattr(R, "MOST_KEYS", most)
            frame = index.search(asked, 5)
            assert "CoGroup" in frame._jdf.queryExecution().optimizedPlan().toString()
            assert sorted((r["query"], r["id"], r["rank"]) for r in frame.collect()) == brute(docs, queries, 5)
        docs |= {3: "w1 lone lone", 950: "new w9 lone"}
        docs.pop(7, None)


def test_queries_of_one_share_go_to_the_rows_of_documents(spark, tmp_path, monkeypatch):
    """No posting is shuffled for them: only the best k of each query leave a task, through changes of documents and many batches."""
    for name, value in {"MOST_OPENED": -1, "CELLS": 100, "MOST_DENSE": 3}.items():
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr(R.Bm25Index, "BLOCK_DOCS", 10)
    monkeypatch.setattr(R.Bm25Index, "BLOCK_POSTINGS", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(8)
    docs = texts(rng, 150) | {900: None, 901: "", 903: "lone", 904: "lone"}
    queries = [(q, " ".join(f"w{int(1.35 ** rng.randrange(26))}" for _ in range(rng.randrange(1, 30)))) for q in range(15)] + [(90, "lone w1"), (91, ""), (92, "unheard")]
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")
    asked = spark.createDataFrame(queries, "query long, text string")
    try:
        for step in range(2):
            folder = Path(index.refresh(spark.createDataFrame([*docs.items()], DOCS))["segments"][-1]["folder"].removeprefix("file://"))
            assert all(f.name.endswith(".zstd.parquet") for what in ("rows", "index") for f in (folder / what).glob("*.parquet"))
            for most in (store.MOST_KEYS, 0):
                monkeypatch.setattr(R, "MOST_KEYS", most)
                frame = index.search(asked, 5)
                plan = frame._jdf.queryExecution().optimizedPlan().toString()
                assert "CoGroup" not in plan and "Generate" not in plan and "Repartition" not in plan
                assert sorted((r["query"], r["id"], r["rank"]) for r in frame.collect()) == brute(docs, queries, 5)
            docs |= {3: "w1 lone lone", 950: "new w9 lone"}
            docs.pop(7, None)
        assert index.search(asked.where("query = 92"), 5).count() == 0
        monkeypatch.setattr(R, "MOST_ASKED", 3)
        assert "CoGroup" in index.search(asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_shares_of_queries_go_to_the_rows_of_documents(spark, tmp_path, monkeypatch):
    """Beyond a bound no posting is copied for each share of queries, and a share has two tasks a core at most, of however many files the rows are."""
    for name, value in {"MOST_OPENED": -1, "MOST_COPIES": 0, "SHARE_TERMS": 60, "CELLS": 100, "MOST_DENSE": 3, "MOST_KEYS": 0}.items():
        monkeypatch.setattr(R, name, value, raising=False)
    monkeypatch.setattr(R.Bm25Index, "BLOCK_DOCS", 5)
    rng = random.Random(9)
    docs = texts(rng, 150) | {900: None, 901: "", 903: "lone", 904: "lone"}
    queries = [(q, " ".join(f"w{int(1.35 ** rng.randrange(26))}" for _ in range(rng.randrange(1, 30)))) for q in range(15)] + [(90, "lone w1"), (91, ""), (92, "unheard")]
    index = R.Bm25Index(spark, f"file://{tmp_path}/bm25")
    asked = spark.createDataFrame(queries, "query long, text string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a task for each file
    for step in range(2):
        index.refresh(spark.createDataFrame([*docs.items()], DOCS).repartition(30))
        frame = index.search(asked, 5)
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" not in plan and "Generate" not in plan
        shares, most = plan.count("MapInArrow"), 2 * spark.sparkContext.defaultParallelism
        assert shares > 1 and index.table.read().rdd.getNumPartitions() > most and plan.count(f"Repartition {most}, false") == shares
        assert sorted((r["query"], r["id"], r["rank"]) for r in frame.collect()) == brute(docs, queries, 5)
        docs |= {3: "w1 lone lone", 950: "new w9 lone"}
        docs.pop(7, None)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(R, "MOST_ASKED", 6)
    monkeypatch.setattr(R, "SHARE_TERMS", 1 << 20)
    assert index.search(asked, 5)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3


def test_a_ranking_is_sent_to_the_documents_of_other_sources(spark, tmp_path):
    """No document's id is shuffled for it, and a document of several rows counts as often as in its SQL's join."""
    spark.createDataFrame([(1, "a", "en", "src0", 1), (2, "b", "en", "src1", 1), (2, "c", "en", "src2", 1), (3, "d", "en", "src1", 1), (4, "e", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ranked = spark.createDataFrame([(7, 1, 9.0, 1), (7, 2, 8.0, 2), (7, 4, 7.0, 3), (8, 3, 6.0, 1)], "query long, id long, score double, rank int")
    found = retrieval_queries._outside(spark, f"file://{tmp_path}", store.small(ranked))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted((r["query"], r["id"], r["rank"]) for r in found.collect()) == [(7, 2, 2), (7, 2, 2), (8, 3, 1)]


def test_gold_groups_are_whole(spark, tmp_path):
    """Every gold document of every item: parts of words, texts without words, ids that repeat or are missing; items that none holds."""
    docs = [(1, "to concatenate, as it were"), (2, "the cat sat!!!"), (2, "another row: the cat sat"), (None, "no id, the cat sat on it"), (3, "preheating over headlines soon"), (4, ""), (5, None), (6, "CAT; the CAT SAT")]
    items = [(10, "cat"), (11, "!!!"), (12, ""), (13, None), (14, "the cat sat"), (15, "at, as"), (16, "heating over head"), (17, "not there at all"), (18, "zebra"), (10, "CAT SAT"), (None, "the cat"), (19, "the cat sat on it"), (20, "the cat sat")]
    spark.createDataFrame([(i, x, "en", "src0", None) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gold = [(q, i) for q, needle in items for i, text in docs if needle is not None and text is not None and needle in text]
    every = lambda rows: sorted(rows, key=repr)
    assert every(tuple(r) for r in retrieval_queries.gold_documents(spark, f"file://{tmp_path}").collect()) == every(gold)
    want = []
    for q in {q for q, _ in items}:
        mine = [i for of, i in gold if of == q]
        first = min((i for i in mine if i is not None), default=None)
        want += [(q, len(mine), first, i) for i in mine] or [(q, 0, None, None)]
    got = retrieval_queries.gold_groups(spark, f"file://{tmp_path}").select("query", "n_gold", "first_gold", "id").collect()
    assert every(map(tuple, got)) == every(want)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert every(con.execute(catalogue.ORACLES["gold_groups"]).fetchall()) == every(want)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="needs the test tables")
def test_no_text_is_shuffled_for_what_was_found(spark, monkeypatch):
    """Rankings and gold documents go to the documents; these are read as they lie, neither dealt out nor shuffled."""
    found = spark.createDataFrame([(1, 2, 3.0, 1)], "query long, id long, score double, rank int")
    monkeypatch.setattr(retrieval_queries, "_index", lambda spark, d: SimpleNamespace(search=lambda queries, k: found))
    monkeypatch.setattr(evaluation_queries, "gold_documents", lambda spark, d: found.select("query", "id"))
    for f in (retrieval_queries.drop_selected_duplicate, retrieval_queries.context_summary, retrieval_queries.context_build, retrieval_queries.second_pass_rerank, evaluation_queries.benchmark_build):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition " not in plan and "strategy=broadcast" in plan, f.__name__
