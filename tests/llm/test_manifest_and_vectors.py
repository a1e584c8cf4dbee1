"""Merkle manifest, centroid clustering and exact top-k against brute force, with the cases that could break them."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import centroids, kdtree, merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


# Merkle manifest


def brute_tree(hashes):
    steps, place, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, p in enumerate(place):
            steps[k].append(("".join(level[p // 8 * 8 : p]), "".join(level[p + 1 : p // 8 * 8 + 8])))
            place[k] = p // 8
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], steps


def brute_audit(rows):
    def leaf(r, text):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    trees, out = defaultdict(list), []
    for r in rows:
        low = r["text"] if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        trees[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, low if hit else r["text"])))
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    own = {t: brute_tree([x[1] for x in trees[t]]) for t in names}
    root, above = brute_tree([own[t][0] for t in names])
    for t, top in zip(names, above, strict=True):
        for (doc, leaf_, seen), path in zip(trees[t], own[t][1], strict=True):
            at = seen
            for before, after in path + top:
                at = digest(before, at, after)
            out.append((doc, leaf_, own[t][0], root, digest(*(b + a for b, a in path + top)), at, at == root))
    return out


KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, up string"


def test_manifest_is_the_brute_force_tree(spark):
    """Trees of more than one block, of a single leaf, of null and empty names; ties and repeated rows; clashing columns."""
    langs = [None, "a", "B", "ß", "", *(f"l{k}" for k in range(9))]
    rows = [(i if i % 7 else None, "Text " * (i % 3), "a" if i % 3 else langs[i % len(langs)], "s", i) for i in range(1400)]
    rows += [(1, "Same", None, None, None)] * 600 + [(4, None, "a", "s", 0), (4, "", "a", "s", 0), (5, "LONG " * 50_000, "once", "s", 250_000)]
    docs = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], KIND)
    got = merkle.audit(docs).collect()
    assert ordered(got) == ordered(brute_audit([r.asDict() for r in docs.collect()]))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 512, 513])
def test_manifest_of_any_size(spark, n):
    docs = spark.createDataFrame([(k, f"T{k}", "en", "s", 2, "x", 0, "y") for k in range(n)], KIND)
    assert ordered(merkle.audit(docs).collect()) == ordered(brute_audit([r.asDict() for r in docs.collect()]) if n else [])


def test_a_changed_row_fails_and_the_others_hold(spark):
    leaves = spark.range(700).select(F.lit("t").alias("tree"), "id", merkle.sha(F.col("id").cast("string")).alias("leaf"))
    proven = merkle.authenticate(leaves, "tree", "leaf", "id").withColumn("seen", F.when(F.col("id") == 77, merkle.sha(F.lit("x"))).otherwise(F.col("leaf")))
    bad = proven.where(merkle.fold(F.col("seen"), F.col("steps")) != F.col("root"))
    assert [r["id"] for r in bad.collect()] == [77]


def test_no_join_in_the_proofs(spark):
    """The proofs' plan shuffles once, by blocks, and joins nothing."""
    docs = spark.createDataFrame([(k, f"T{k}", "en", "s", 2, "x", 0, "y") for k in range(600)], KIND)
    plan = merkle.audit(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


# Centroid clustering

ODD = [(None, [0.5] * 64), (7, None), (8, [1.0] * 63), (9, [1.0] * 65), (10, [1.0] * 63 + [None]), (11, [math.inf] + [0.0] * 63), (12, [math.nan] * 64), (13, []), (14, [-0.25] * 64), (14, [-0.25] * 64)]
VECTORS = "vec_id long, embedding array<double>, cluster string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], VECTORS)


def brute_clusters(rows):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:8]
    centres = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(10):
        best = assign()
        for k in range(len(centres)):
            own = [kept[j][1] for j, b in enumerate(best) if b[1] == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = assign()
    inertia = [sum(d for d, c in best if c == k) for k in range(len(centres))]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, best, strict=True)]


@pytest.mark.parametrize("n", [0, 3, 8, 400])
def test_clusters_are_the_brute_force_ones(spark, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice((-1, 1)) * rng.random() * (1 + k % 5) for _ in range(64)]) for k in range(n)]
    rows += [(1000 + k, [0.125] * 64) for k in range(n // 3)] + (ODD if n else [])
    assert ordered(centroids.clusters(frame(spark, rows)).collect()) == ordered(brute_clusters(rows))


def test_orchard_search_is_exact_and_measures_less():
    """Grids of small whole numbers are full of ties; the search finds the smallest number among them."""
    rng = np.random.default_rng(1)
    for k, side in ((1, 3), (2, 3), (40, 3), (300, 60)):
        centres = rng.integers(0, side, (k, 3)) * (1 if side == 3 else 50)
        points = rng.integers(0, side, (500, 3)) * (1 if side == 3 else 50)
        best, near, measured = centroids.orchard(points, centres, centroids.neighbour_lists(centres))
        apart = ((points[:, None, :] - centres[None]) ** 2).sum(-1)
        assert (best == apart.argmin(1)).all() and (near == apart.min(1)).all()
    assert measured < 500 * 300 // 3


def test_very_large_components_are_held(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    got = centroids.clusters(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["distance"] == 0 for r in got)


# Exact top-k


def brute_top(rows):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for c, (j, w) in enumerate(kept) if c != q)[:20]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("n", [0, 1, 15, 700])
def test_top_k_is_the_brute_force_one(spark, n, monkeypatch):
    """Small shards and blocks, so that several groups of several shards meet; a third of the rows are copies, ids repeat."""
    monkeypatch.setattr(kdtree, "SHARD_BYTES", 4 * 64 * 30)
    monkeypatch.setattr(kdtree, "BLOCK_BYTES", 4 * 64 * 4)
    rng = random.Random(n)
    rows = [(k - 5, [rng.gauss(0, 1) for _ in range(64)]) for k in range(n)] + [(20 * k, [0.25] * 64) for k in range(n // 3)] + [(20, [1.0] * 64)] * (n // 100)
    rows += ODD if n else []
    got = kdtree.top_k(frame(spark, rows))
    assert ordered(got.collect()) == ordered(brute_top(rows))


def test_a_tree_prunes_clustered_vectors():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 1, (500, 8)).round() for c in rng.normal(0, 60, (16, 8))])
    tree, numbers = kdtree.Tree(points, leaf=64), np.arange(len(points))
    found = [kdtree.Best(5)]
    computed = kdtree.search(tree, tree.order, numbers[tree.order], points[:1], np.array([0]), found)
    score = points @ points[0]
    assert found[0].rows[:, 0].tolist() == sorted(score[1:], reverse=True)[:5]
    assert computed < len(points) / 4


def test_products_beyond_doubles_are_exact(spark):
    big = [[float((1 << 19) + k)] * 64 for k in range(30)]
    rows = [(k, v) for k, v in enumerate(big)]
    assert ordered(kdtree.top_k(frame(spark, rows)).collect()) == ordered(brute_top(rows))
