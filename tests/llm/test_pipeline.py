"""The corpus pipeline's stages and the registered queries."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import queries

DATA = "/root/testdata/sf0.001"


def words(text):
    return (text or "").lower().split()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for before, after in zip(seen[:4], seen[1:5], strict=True):
        assert after.columns == docs.columns
        assert after.schema == docs.schema
        assert after.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    rejected = ids[0] - ids[1]
    truth = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    assert sum(truth.get(d) == 1 for d in rejected) <= 0.03 * sum(truth.values())
    assert sum(truth.get(d) == 0 for d in rejected) >= 0.5 * sum(q == 0 for q in truth.values())
    texts = {r.doc_id: words(r.text) for r in seen[2].collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(any(alike(d, e) for e in texts if e != d) for d in ids[2] - ids[3])
    assert not any(alike(d, e) for d in ids[3] for e in ids[3] if d < e and texts[d] == texts[e])
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in seen[4].collect() for i in items)
    tokens = seen[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert tokens.where("n != all").count() == 0
    assert {r.doc_id for r in tokens.collect()} == ids[4]


def test_line_stage_loses_no_text(spark):
    text = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    p, q, r = text("p", 80), text("q", 80), text("r", 60)
    rows = [(1, f"{q}\n{p}"), (2, f"{q}\n{p}\n{text('own', 20)}"), (3, "\n".join([r] * 9)), (4, f"{q}\n{r}\n{text('new', 10)}"), (5, f"{p}\n{q}")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x.doc_id: x.text.split() for x in corpus_pipeline.lines(spark, docs, DATA).collect()}
    assert left == {1: f"{q} {p}".split(), 2: text("own", 20).split(), 3: r.split(), 4: text("new", 10).split()}


def test_pipeline_takes_empty_and_odd_tables(spark, tmp_path):
    odd = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "no id " * 20, "en", "s", 120), (3, "same text here", "en", "s", 14), (3, "same text here", "en", "s", 14)]
    for name, rows in (("empty", []), ("odd", odd)):
        folder = tmp_path / name
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == bool(rows)


def test_warc_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    found = con.execute(queries.ORACLES["op4_warc"])
    names, want = [x[0] for x in found.description], found.fetchall()
    assert sorted(tuple(r[n] for n in names) for r in queries.op4_warc(spark, DATA).collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_every_row(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert got.count() >= spark.read.parquet(f"{DATA}/{'pages' if name == 'op4_warc' else 'documents'}.parquet").count()
