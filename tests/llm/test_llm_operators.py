"""Training-data operators against brute force, round trips and held-out accuracy, with the cases that could break them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import decontaminate, eliasfano, linededup, lm, packing, pii, pu, queries, rules, sharding, simhash, warc
from foliant.llm.components import connected_components
from foliant.llm.docstats import BASE, COUNTS, FEATURES, counts, features

DATA = "/root/testdata/sf0.001"
#: Null and empty texts, no id, repeated rows, a very long text, ties; and a column whose name operators use themselves.
ODD = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "no id here at all", "x"), (4, "same row", "x"), (4, "same row", "x"), (5, "long " * 60_000, "x"), (6, "ß Ünïcode ₤ 漢字   é", "x")]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("runs", "row", "fp", "tokens", "seed", "g", "pos")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passage(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) + ("." if k % 8 == 7 else "") for k in range(n)) + "."


# SimHash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i in range(len(prints))}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_simhash_against_brute_force(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(d, t) for d, t, _ in ODD]
    near = [(10_000 + k, t.replace("the", "teh", 1)) for k, (_, t) in enumerate(rows[:40]) if t]
    every = rows + near
    prints = [(d, brute_fingerprint(t)) for d, t in every]
    want = Counter(zip((d for d, _ in prints), (f"{p:016x}" for _, p in prints), brute_components(prints), strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(every, "doc_id long, text string")).collect())
    assert got == want
    assert simhash.near_duplicates(odd).count() == len(ODD)


def test_simhash_keeps_one_and_takes_nothing(spark, none):
    assert simhash.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(3, "a b c d", "z"), (1, "A b C d", "y"), (2, "quite another text here", "x")], SCHEMA)
    assert {r.doc_id for r in simhash.keep_one(rows).collect()} == {1, 2}
    assert simhash.keep_one(none, prints=3).count() == 0


def test_simhash_with_more_prints_finds_more_near_copies(spark):
    rng, rows = random.Random(9), []
    for k in range(120):
        own = passage(300, k).split()
        near = own[:]
        for at in rng.sample(range(300), 6):
            near[at] = f"edit{at}"
        rows += [(k, " ".join(own)), (1000 + k, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id for r in simhash.keep_one(docs, budget=b, prints=n).collect()} for b, n in ((3, 1), (4, 8)))
    assert set(range(120)) <= many < one
    checked = {r.doc_id for r in simhash.keep_one(docs, budget=4, prints=4, check=(5, 0.75)).collect()}
    assert checked == brute_kept(rows, 0.75) == set(range(120))
    strict = {r.doc_id for r in simhash.keep_one(docs, budget=4, prints=4, check=(5, 0.99)).collect()}
    assert len(strict) == 240


def edited(words, places, tag):
    """The words with others at these places."""
    return [f"{tag}x{k}" if k in places else w for k, w in enumerate(words)]


def brute_kept(rows, share):
    """The least id of each group of texts that share so much of their five-word shingles."""
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in rows}
    up = {d: d for d in sets}

    def top(d):
        return d if up[d] == d else top(up[d])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d for d in up if up[d] == d}


@pytest.mark.parametrize("prints", [4, 0])
@pytest.mark.parametrize("bounds", [None, (20, 3)])
def test_checked_links_leave_no_near_pair(spark, monkeypatch, bounds, prints):
    """Substitutions and dropped tails around the bound of 0.8, and pairs in a template whose texts differ elsewhere."""
    if bounds:
        monkeypatch.setattr(simhash, "_SAMPLE", bounds[0])
        monkeypatch.setattr(simhash, "_COMMON", bounds[1])
    rng, rows = random.Random(4), []
    for k in range(60):
        own = passage(200, 500 + k).split()
        rows += [(k, own), (1000 + k, edited(own, set(rng.sample(range(200), 1 + k % 6)), f"e{k}")), (2000 + k, own[: 150 + k]), (3000 + k, edited(own, {5, 90}, f"f{k}"))]
    frame = passage(150, 9).split()
    for k in range(60):
        own = frame + passage(60, 900 + k).split()
        rows += [(5000 + 2 * k, own), (5001 + 2 * k, edited(own, {100 + k % 9}, f"g{k}"))]
    rows = [(d, " ".join(w)) for d, w in rows]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), budget=4, prints=prints, check=(5, 0.8)).collect()}
    assert got == brute_kept(rows, 0.8)
    assert 60 < len(got) < len(rows)


def test_meetings_find_all_pairs_of_the_share_and_few_others(spark):
    """The exact search alone: sets of unlike sizes around the bound, and pairs that share one passage only."""
    rng, rows = random.Random(6), []
    for k in range(40):
        own = passage(100 + k, 3000 + k).split()
        rows += [(4 * k, own), (4 * k + 1, own + passage(15 + k // 2, 4000 + k).split()), (4 * k + 2, edited(own, {k, 50 + k % 9}, f"h{k}"))]
        rows += [(4 * k + 3, passage(12, 77).split() + passage(90 + rng.randrange(9), 5000 + k).split())]
    rows = [(d, " ".join(w)) for d, w in rows]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    near = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = simhash.shingle_heads(docs, 5, 0.8, simhash.common_shingles(docs, 5), 0, 3)
    leads = heads.select(F.col("doc_id").alias("id"), "size", F.col("doc_id").alias("part"), F.posexplode("lead").alias("place", "token"))
    met = {(r.a, r.b) for r in simhash._meetings(leads, 0.8, False).collect()}
    assert near <= met
    assert 40 < len(near) <= len(met) < 1.5 * len(near)


def test_checked_fingerprints_test_every_pair(spark):
    """Three texts of one fingerprint, of which only the last two are alike: the first can't stand for the second."""
    same, tails = " ".join([passage(9, 1)] * 300), [passage(80, k) for k in (2, 3)]
    rows = [(0, f"{same} {tails[0]}"), (1, f"{same} {tails[1]}"), (2, f"{same} {tails[1]} end")]
    assert len({simhash.fingerprint(t.encode()) for _, t in rows}) == 1
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), check=(5, 0.8)).collect()}
    assert got == {0, 1}


@pytest.mark.parametrize("depth", [0, 5])
def test_trie_join_links_like_all_pairs(depth):
    rng = np.random.default_rng(depth)
    keys = rng.integers(0, 2**64, 200, dtype=np.uint64)
    for _ in range(6):
        more = keys[rng.integers(0, len(keys), 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
        keys = np.unique(np.concatenate([keys, more]))
    a, b = simhash.trie_links(keys, depth, 3)
    own, all_pairs = simhash._Sets(len(keys)), simhash._Sets(len(keys))
    own.link(a, b)
    x, y = np.triu_indices(len(keys), 1)
    near = (np.bitwise_count(keys[x] ^ keys[y]) <= 3) & (keys[x] >> np.uint64(63 - depth) >> np.uint64(1) == keys[y] >> np.uint64(63 - depth) >> np.uint64(1))
    all_pairs.link(x[near], y[near])
    assert np.array_equal(own.flatten(), all_pairs.flatten())


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(500, k) for k in range(501, 560)] + [(900, 900), (None, 1)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(500, 560), 500)}


# Line dedup


def test_line_dedup_cuts_later_passages_only(spark):
    p, q = passage(64, 1), passage(70, 2)
    rows = [
        (1, f"Own words one.\n{p}\nMore own words."), (2, f"Other start. {p} Other end."), (3, f"{q}\nAlone."), (4, f"Short. {p}\n{q} Tail."),
        (5, "All rights reserved.\nClean text that nobody repeats."), (6, "All rights reserved.\nAnother clean text of its own."), (7, f"{p}\nIn between.\n{p}"),
    ]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d].text for d in (1, 3, 5, 6)} == {d: t for d, t in rows if d in (1, 3, 5, 6)}
    assert got[2].text == "Other start. Other end."
    assert got[4].text == "Short. Tail."
    assert got[7].text == "In between.\n"
    assert {r.source for r in got[4].runs} == {1, 3}


def test_line_dedup_finds_every_long_repeat(spark):
    """Whatever two documents share in whole units, 50 words or more, is gone from the later one."""
    rng, rows = random.Random(5), []
    parts = [passage(rng.randint(50, 90), k) for k in range(12)]
    for d in range(60):
        own = [passage(rng.randint(5, 60), 1000 + 20 * d + k) for k in range(4)]
        rows.append((d, "\n".join(x for k in range(3) for x in (own[k], *([rng.choice(parts)] if rng.random() < 0.6 else [])))))
    left = [r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    for part in parts:
        assert sum(part in t for t in left) == min(1, sum(part in t for _, t in rows))
    assert all(r.text == t for r, (_, t) in zip(spark.createDataFrame(rows[:1], "doc_id long, text string").collect(), rows[:1], strict=True))


def test_line_dedup_does_not_mind_blank_lines(spark):
    lines = [passage(10, 40 + k) for k in range(8)]
    rows = [(1, "Own.\n" + "\n".join(lines)), (2, "\n\n".join(lines)), (3, "\n \t\n".join(lines) + "\r\nLast words."), (4, "\n".join(lines[:4]) + "\n\n\n" + "\n".join(lines[4:]))]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d].text.strip() for d in (1, 2, 3, 4)] == [rows[0][1], "", "Last words.", ""]
    assert (got[1].removed_units, got[1].n_units) == (0, None)
    assert all(got[d].removed_units >= 8 for d in (2, 3, 4))
    assert (got[2].words_left, got[3].words_left) == (0, 2)


def test_line_dedup_takes_every_text_of_an_id(spark):
    p, q = passage(80, 70), passage(80, 71)
    rows = [(1, p), (2, f"{q}\nfirst of two"), (2, f"{p}\nsecond of two"), (3, q), (3, q)]
    got = sorted(r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([p, f"{q}\nfirst of two", "second of two", "", ""])


def brute_lines(rows, least, margin=0):
    """Units of each text outside runs of ``least`` words or more that stand earlier in it or in an earlier text, and
    those of such runs that lie within ``margin`` words of their ends."""
    split = {d: [(u.strip(), len(u.split())) for u in re.split(r"(?<=\n)|(?<=[.!?…] )", t) if u.strip()] for d, t in rows}
    gone = {d: set() for d in split}
    for d, own in split.items():
        for e, other in split.items():
            if e > d:
                continue
            for i in range(len(own)):
                for j in range(len(other) if e < d else i):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n][0] == other[j + n][0]:
                        n += 1
                    size = [w for _, w in own[i : i + n]]
                    if sum(size) >= least:
                        gone[d] |= {i + k for k in range(n) if sum(size[:k]) >= margin and sum(size[k + 1 :]) >= margin}
    return {d: [u for k, (u, _) in enumerate(own) if k not in gone[d]] for d, own in split.items()}


def test_line_dedup_against_brute_force(spark):
    """Everything cut repeats earlier for 30 words, and of every earlier repeat of 49 words only ends may stay."""
    rng, pool, rows = random.Random(8), [passage(rng_n, 300 + rng_n) for rng_n in range(3, 25)], []
    shared = ["\n".join(rng.sample(pool, 5)) for _ in range(6)]
    for d in range(50):
        parts = [rng.choice([*shared, *pool, *pool, "", passage(rng.randint(2, 20), 5000 + 10 * d + k)]) for k in range(8)]
        rows.append((d, rng.choice(["\n", "\n\n"]).join(parts)))
    got = {r.doc_id: [u.strip() for u in re.split(r"(?<=\n)|(?<=[.!?…] )", r.text) if u.strip()] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    most, least = brute_lines(rows, 30), brute_lines(rows, 49, 28)
    for d, _ in rows:
        assert not Counter(got[d]) - Counter(least[d])
        assert not Counter(most[d]) - Counter(got[d])
    assert sum(map(len, got.values())) < sum(len(t.split("\n")) for _, t in rows)


def test_line_dedup_odd_rows(odd, none):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r.text for r in got}
    assert (by[1], by[2], by[3], by[None], by[4]) == (None, "", " \t\n", "no id here at all", "same row")
    assert linededup.dedup_lines(none).count() == 0


# Quality


def test_pu_separates_held_out_labels(spark):
    found = queries.op2_pu_quality(spark, "/root/testdata/sf0.01").toPandas()
    truth = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df()
    both = found[found.held_out].merge(truth, on="doc_id")
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.95
    assert (good >= 0.5).mean() > 0.97
    assert len(found) == 1000
    assert found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in found.doc_id]).all()


def test_pu_reads_no_held_out_label(spark, docs, labels):
    lied = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in pu.quality_scores(docs, x).collect()} for x in (labels, lied))
    assert a == b


def test_pu_odd_rows(spark, odd, none, labels):
    assert pu.quality_scores(odd, labels).count() == len(ODD)
    assert {r.score for r in pu.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert pu.quality_scores(none, labels).count() == 0


def brute_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_counts_against_brute_force(docs):
    for r in docs.collect():
        assert counts(r.text.encode())[: len(BASE)] == brute_counts(r.text)
    for _, t, _ in ODD:
        assert counts((t or "").encode())[: len(BASE)] == brute_counts(t)
    assert counts(b"a b c d e a b c d e")[4] == 10


def test_trees_are_monotone_and_apply_the_base_rules(spark, docs, labels):
    found = rules.judge(docs, labels).toPandas()
    failed = (found.n_words < 10) | (100 * found.n_repeat_words > 20 * found.n_words)
    assert (found.base_failed == failed).all()
    assert not found[failed].kept.any()
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(3000) < 0.7).astype(float)
    trees = rules.fit(x, y, rounds=15)
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.85
    for name, sign in rules.MONOTONE.items():
        k = FEATURES.index(name)
        up = x.copy()
        up[:, k] += rng.random(3000)
        assert (sign * (trees.margin(up) - trees.margin(x)) >= -1e-9).all()


def test_trees_odd_rows(odd, none, labels):
    got = rules.judge(odd, labels).collect()
    assert len(got) == len(ODD)
    assert [r.kept for r in got if r.doc_id in (1, 2, 3)] == [False] * 3
    assert rules.judge(odd, labels.limit(0)).where("kept").count() == 0
    assert rules.judge(none, labels).count() == 0
    assert features(np.zeros((1, len(COUNTS)), int)).shape == (1, len(FEATURES))


# Decontamination


def test_decontamination_tolerates_substitutions(spark):
    items = [passage(36, k).replace(".", "") for k in range(6)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "of the"), (92, "seven short words stand in this item")], "item_id long, text string")
    rng, rows, want = random.Random(1), [], {}
    for k in range(24):
        w = items[k % 6].split()
        for at in rng.sample(range(36), k // 4):
            w[at] = f"other{at}"
        rows.append((k, f"{passage(40, 50 + k)} {' '.join(w).upper() if k % 2 else ' '.join(w)}, {passage(30, 90 + k)}"))
        want[k] = [k % 6]
    rows += [(100, passage(200, 7)), (101, "and of the by"), (102, "So: seven short words, stand in this item!"), (103, items[0][: len(items[0]) // 3])]
    want |= {100: [], 101: [], 102: [92], 103: []}
    for settings in ({}, {"max_seeds": 0}):
        assert {r.doc_id: list(r["items"]) for r in decontaminate.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), bench, **settings).collect()} == want
    kept = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r.doc_id for r in kept.collect()} == {100, 101, 103}


def _solid(equal: np.ndarray) -> np.ndarray:
    """Which tokens of each row count as matched: equal ones with three of the five around them."""
    wide = np.pad(equal, ((0, 0), (2, 2)))
    return (equal == 1) & (sum(wide[:, d : d + equal.shape[1]] for d in range(5)) >= 3)


def test_masks_hit_every_accepted_choice_of_substitutions():
    for n in range(5, 17):
        equal = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(np.int8)
        equal = equal[_solid(equal).sum(axis=1) >= 0.6 * n - 1e-9]
        masks = decontaminate.MASKS[max(k for k in decontaminate.MASKS if k <= n)]
        hit = np.zeros(len(equal), bool)
        for mask in masks:
            kept = [k for k, bit in enumerate(mask) if bit == "1"]
            for at in range(n - len(mask) + 1):
                hit |= equal[:, [at + k for k in kept]].all(axis=1)
        assert hit.all(), n


def test_decontamination_of_short_items_against_brute_force(spark):
    rng = random.Random(5)
    lengths = [5, 6, 7, 8, 10, 12, 15, 18, 24, 25, 40]
    items = [[f"w{rng.randrange(40)}" for _ in range(n)] for n in lengths]
    docs = []
    for k in range(220):
        w = list(items[k % len(items)])
        for at in rng.sample(range(len(w)), rng.randrange(len(w) // 2 + 1)):
            w[at] = f"x{at}"
        docs.append([f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))] + w + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in decontaminate.verdicts(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), bench).collect()}
    must = exact = 0
    for i, doc in enumerate(docs):
        for j, item in enumerate(items):
            n = len(item)
            shifts = range(-n, len(doc))
            equal = np.array([[0 <= s + k < len(doc) and doc[s + k] == item[k] for k in range(n)] for s in shifts]).astype(np.int8)
            solid = _solid(equal)
            if solid.sum(axis=1).max() >= 0.6 * n - 1e-9 and n < 17:
                must += 1
                assert j in got[i], (i, j)
            if max(solid[max(0, s - 2 * n) : s + 2 * n].any(axis=0).sum() for s in range(len(shifts))) < 0.6 * n - 1e-9:
                exact += 1
                assert j not in got[i], (i, j)
    assert must > 50 and exact > 1000


def test_decontamination_adds_up_near_places_only(spark):
    item = passage(30, 3).replace(".", "").split()
    near, far = item[:11] + ["new"] + item[11:22], item[:11] + passage(200, 8).split() + item[11:22]
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    got = decontaminate.verdicts(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: True, 2: False}


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "long " * 20), (2, "a b c d e f")], "item_id long, text string")
    got = decontaminate.verdicts(odd, bench).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id for r in got if r.contaminated} == {5}
    assert decontaminate.verdicts(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.verdicts(none, bench).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "body " * 60
    rows = [(5, "http://a/5", big), (2, "http://a/2", big), (9, None, big), (1, "http://a/1", "tiny"), (0, "http://a/0", "tiny"), (3, "u", None), (4, "u\r\nX: y", ""), (None, "n", "no id" * 50), (7, "u", big), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.archive_pages(pages, f"file://{tmp_path}/w", archive_bytes=2000).collect()
    assert len(got) == len(rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(2, "response", None): 1, (5, "revisit", 2): 1, (9, "revisit", 2): 1, (7, "revisit", 2): 2, (1, "response", None): 1, (0, "response", None): 1, (3, "response", None): 1, (4, "response", None): 1, (None, "response", None): 1})
    text = {2: big, 1: "tiny", 3: "", 4: ""}
    for r in got:
        if r.page_id in text:
            assert bytes(r.payload) == text[r.page_id].encode()
            assert r.payload_digest == hashlib.sha256(text[r.page_id].encode()).hexdigest()
    archive = min((tmp_path / "w").glob("part-*")).read_bytes()
    assert archive[:4] == b"\x5d\x2a\x4d\x18"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_dictionary_pays(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    with_it, without = (warc.write_archives(pages, dictionary_bytes=n).agg(F.sum("bytes")).first()[0] for n in (64 << 10, 256))
    assert with_it < without


# PII


def brute_spans(text):
    found = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


TRICKY = [
    "a@b.cd_x@e.f 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 x@y a@@b.c 4111 1111 1111 1111 +1 (555) 123-4567. é+49 30 123456789 ... +1",
    "a.b@c.d@e.f a@b.c. 1.2.3 +12345678901234567890 4111-1111-1111-1112", "漢字a@b.co 4111111111111111" * 3, "+1 2 3 4 5 6 7 8 9 +1+1+123456789", "9" * 4000 + "@x.y " + "a" * 4000 + "@",
]


def test_pii_base_spans_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(TRICKY)] + [(d, t) for d, t, _ in ODD if d]
    want = Counter((d, hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest(), *(sum(s.startswith(k) for s in brute_spans(t)) for k in ("email", "ip", "card", "phone"))) for d, t in rows)
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want


def test_pii_finds_disclosing_terms_and_sanitises(spark):
    rows = [(k, f"{passage(12, k)} Write to Zebulon Quimby at zq@corp.example or not {passage(9, 50 + k)}") for k in range(4)] + [(10 + k, f"Write to me at u{k}@corp.example or not {passage(9, 90 + k)}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own_spans", F.lit("clash"))
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("[TERM] [TERM] at [EMAIL]" in got[k] for k in range(4))
    assert all(got[10 + k].startswith("Write to me at [EMAIL] or not") for k in range(40))
    spans = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    assert spans[0].count("term:") == 2
    assert "term:" not in spans[12]


def test_pii_counts_a_document_once_for_a_pair(spark):
    """A term beside two places of one entity in each of two documents, and elsewhere alone, isn't bound to it."""
    both = "alpha Quimby zq@corp.example {} and then beta Quimby zq@corp.example gamma"
    rows = [(k, both.format(passage(40, k))) for k in range(2)] + [(10 + k, f"Quimby alone {passage(9, 70 + k)}") for k in range(6)] + [(30 + k, passage(9, 200 + k)) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.disclosing_terms(docs, pii.find_base(docs), threshold=0.0).join(docs, "doc_id")
    said = {round(r.disclosure, 9) for r in found.where("lower(substring(text, start + 1, end - start)) = 'quimby'").collect()}
    assert said == {round(math.log2(2 * 32 / (8 * 2)) / math.log2(32 / 2), 9)}


def test_pii_odd_rows(odd, none):
    assert pii.find_spans(odd).count() == len(ODD)
    assert pii.find_spans(none).count() == 0
    assert {r.doc_id: r.text for r in pii.sanitise(odd).collect()}[1] is None


# Sharding


def test_sharding_compacts_and_keeps_all_rows(spark, docs, tmp_path):
    table, rows = sharding.shard_documents(docs, batches=5, target=64 << 20, root=f"file://{tmp_path}/t")
    assert sorted((r.doc_id, r.text) for r in rows.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(table.shards()) < len(table.shards(5))
    with pytest.raises(sharding.ManifestConflict):
        table.commit([], based_on=table.version() - 1)
    assert table.version() == 6
    before = table.shards()
    assert table.compact() == 6
    table.append(docs.limit(1))
    assert len(table.read(docs.schema).where(F.col("shard") == table.shards()[-1]["name"]).collect()) <= 1
    assert table.read(docs.schema).count() == docs.count() + 1
    assert len(table.shards()) > len(before)


def test_sharding_loser_of_a_race_destroys_nothing(spark, docs, tmp_path):
    """Two writers of one application start from the same version; the first to commit wins, and its rows stay whole."""
    one, two = (sharding.ShardedTable(spark, f"file://{tmp_path}/r") for _ in range(2))
    two.version = lambda: 0
    assert one.append(docs) == 1
    with pytest.raises(sharding.ManifestConflict):
        two.append(docs.limit(3))
    assert sorted((r.doc_id, r.text) for r in one.read(docs.schema).collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    written = f"{tmp_path}/r/data/append-00000009-open"
    docs.limit(1).write.parquet(f"file://{written}")
    one.compact()
    one.vacuum()
    assert spark.read.parquet(f"file://{written}").count() == 1
    assert one.read(docs.schema).count() == docs.count()


def test_sharding_plan_is_tiered(spark, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/p")
    shards = [{"name": f"s{k}", "bytes": b, "level": 0} for k, b in enumerate([1 << 10] * 5 + [1 << 16] * 3 + [50 << 20] * 3 + [100 << 20])]
    runs = table.plan(shards, target=128 << 20, fan_in=4)
    assert [[s["name"] for s in r] for r in runs] == [["s0", "s1", "s2", "s3", "s4"], ["s8", "s9"]]


def test_sharding_odd_rows(odd, none):
    assert sharding.shard_documents(odd.withColumn("shard", F.lit("own")))[1].count() == len(ODD)
    assert sharding.shard_documents(none)[1].count() == 0


# Packing


def check_packing(rows, pieces, window=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in rows}
    per_doc, per_sequence = {}, {}
    for p in pieces:
        per_doc.setdefault(p.doc_id, []).append(p)
        per_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
    for d, own in ids.items():
        at = 0
        for p in sorted(per_doc[d], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(own)
    sizes = []
    for own in per_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert max(sizes) <= window
    assert all(n & (n - 1) == 0 for n in sizes)


def test_packing_is_exact_and_without_padding(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, x) for k, x in enumerate([None, "", " ", "a  b", "a \n b", " a", "a ", "x y z", "<|endoftext|> is text", "a\tb c", "long " * 30_000, "one\r\ntwo"])]
    check_packing(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=60_000).collect())


def test_packing_maps_the_special_token(spark):
    rows = [(1, "one <|endoftext|> two"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|> b <|endoftext"), (4, "plain words here")]
    check_packing(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_packing_puts_neighbours_together(spark):
    topics = [passage(30, t) for t in range(8)]
    rows = [(k, " ".join(random.Random(k).sample(topics[k % 8].split(), 20))) for k in range(160)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=1024).toPandas()
    mixed = pieces.groupby("sequence_id").doc_id.agg(lambda d: len({x % 8 for x in d}))
    assert mixed.mean() < 3.5


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd).toPandas()
    assert got[got.start == 0].shape[0] == len(ODD)
    assert packing.pack(none).count() == 0


# Language model


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 5), (1000, 3000), (5000, 10**12), (3000, 2**62), (100, 100)])
def test_elias_fano_access_and_successor(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
    e = eliasfano.EliasFano(values, universe)
    assert np.array_equal(e[np.arange(n)], values)
    if n:
        asked = np.concatenate([values, rng.integers(0, universe, 500).astype(np.uint64)])
        zero = np.zeros(len(asked), np.int64)
        assert np.array_equal(e.successor(asked, zero, zero + n), np.searchsorted(values, asked))


def test_language_model_against_brute_force(spark, docs):
    mu = 50.0
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000, None), (9001, ""), (9002, "only unseenwordhere"), (9003, "The THE the")]
    tokens = {d: [*[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)], None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    uni, bi = Counter(), Counter()
    for d, t in tokens.items():
        if not held[d]:
            uni.update(t)
            bi.update(zip(["<start>", *t[:-1]], t, strict=True))
    n, v, starts = sum(uni.values()), len(uni), sum(not h for h in held.values())
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), mu=mu, shard_tokens=20_000, block_tokens=15_000).collect()}
    assert len(got) == len(rows)
    off = []
    for d, t in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(uni[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10(p1(w)) for w in t), rel_tol=1e-9)
        exact = sum(math.log10((bi[a, w] + mu * p1(w)) / ((starts if a == "<start>" else uni[a]) + mu)) for a, w in zip(["<start>", *t[:-1]], t, strict=True))
        off.append(abs(r.score - exact) / len(t))
    assert np.mean(off) < 0.02


def test_language_model_beats_its_base_on_held_out_text(spark):
    found = queries.op10_ngram_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_language_model_odd_rows(odd, none):
    got = lm.score_documents(odd).collect()
    assert len(got) == len(ODD)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score_documents(none).count() == 0


def test_a_text_without_a_copy_stays_whatever_shares_its_id(spark):
    """(5, A) is a copy of (1, A) and goes; B and C, under the same ids, are in no other row and stay."""
    a, b, c = passage(60, 1), passage(60, 2), passage(60, 3)
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (1, c, "x"), (5, None, "x"), (9, "", "x"), (9, b + " more", "x"), (9, b + " more", "x"), (None, a, "x")]
    for check in (None, (5, 0.8)):
        got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), prints=4, budget=4, check=check).collect()
        texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got)
        assert {(1, a), (5, b), (1, c), (5, ""), (-1, a)} <= set(texts)
        assert (5, a) not in texts and (9, "") not in texts
        if check:
            assert texts == sorted([(1, a), (5, b), (1, c), (5, ""), (-1, a)])


def test_one_id_with_very_many_texts(spark):
    texts = [passage(30, k) for k in range(300)]
    rows = [(7, t, "x") for t in texts] + [(8, texts[3], "x"), (6, texts[4], "x")]
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), check=(5, 0.8)).collect())
    assert got == sorted([(7, t) for t in texts if t != texts[4]] + [(6, texts[4])])


def test_a_large_group_of_copies_with_strangers_costs_the_strangers_only(spark, monkeypatch):
    """Groups beyond the step bound are paired by parts; the result is the same as step by step."""
    base = passage(80, 5).split()
    rows = []
    for k in range(120):
        own = list(base)
        own[k % 80] = f"word{k}"
        rows.append((k, " ".join(own), "x"))
    rows += [(500 + k, " ".join(base[:40] + passage(40, 900 + k).split()), "x") for k in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    found = []
    for steps in (1 << 30, 8):
        monkeypatch.setattr(simhash, "_STEPS", steps)
        found.append({(r.a, r.b) for r in simhash.alike(frame, 5, 0.8, prints=0).collect()})
    closure = [{(r.node, r.component) for r in connected_components(spark.createDataFrame(sorted(f), "a long, b long"), "a", "b").collect()} for f in found]
    assert closure[0] == closure[1] and len(closure[0]) >= 120


def test_a_hot_pair_goes_by_block_and_scores_alike(spark):
    """A corpus of one repeated pair: small shards, in which it is hot, give what one large shard gives."""
    rng = random.Random(9)
    texts = ["ha ho " * rng.randrange(1, 60) + " ".join(rng.choices("abcdefgh", k=rng.randrange(8))) for _ in range(80)] + ["", None, "ho", "ha ha ha"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split, whole = ({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 3), round(r.score, 3)) for r in lm.score_documents(docs, shard_tokens=n, block_tokens=200, least_shards=m).collect()} for n, m in ((160, 16), (1 << 30, 1)))
    assert split.keys() == whole.keys() and all(abs(a - b) < 0.01 for k in whole for a, b in zip(split[k], whole[k], strict=True))
    rows = docs.select("doc_id", "text", F.lit(True).alias("train"))
    digest = lambda w: xxhash.xxh64_intdigest(w.encode())
    v, w, n = lm.hot_pairs(rows, np.array([digest("ha"), digest("ho")], np.uint64), 50, 200)
    want = Counter(p for t in texts for p in zip(words(t), words(t)[1:], strict=False) if set(p) <= {"ha", "ho"})
    assert {(a, b): c for a, b, c in zip(v.tolist(), w.tolist(), n.tolist(), strict=True)} == {(digest(a), digest(b)): c for (a, b), c in want.items() if c > 50}


def test_disclosure_against_brute_force(spark):
    """Random documents with repeated entities, terms at any distance from them, and copies."""
    rng = random.Random(3)
    names, rows = [f"u{k}@corp.example" for k in range(6)], []
    for k in range(140):
        own = rng.randrange(6)
        text = rng.choices([f"tell{own}", f"Tell{own}", "common", "other", f"w{rng.randrange(30)}"], k=rng.randrange(3, 40))
        if rng.random() < 0.6:
            text.insert(rng.randrange(len(text)), names[own])
        rows.append((k, " ".join(text), "x"))
    rows += [(500 + k, rows[k % 3][1], "x") for k in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    texts = [t for _, t, _ in rows]
    holds = {t: set(re.findall(r"[^\W_]+", t.lower())) for t in texts}
    base = pii.find_base(docs).cache()
    entity = {r.entity: r.value for r in base.where("kind is not null").select(F.xxhash64("kind", F.lower("value")).alias("entity"), "value").distinct().collect()}
    ratios = pii.disclosures(docs, base, least=-99.0)[0].collect()
    assert len(ratios) > 20
    for r in ratios:
        name = entity[r.entity]
        n, t, e = len(texts), sum(r.term in holds[x] for x in texts), sum(name in x for x in texts)
        both = sum(r.term in holds[x] and name in x for x in texts)
        assert math.isclose(r.disclosure, math.log2(both * n / (t * e)) / math.log2(n / e), abs_tol=1e-9)
    strong = {(r.term, entity[r.entity]) for r in ratios if r.disclosure >= 0.7}
    assert strong and strong == {(r.term, entity[r.entity]) for r in pii.disclosures(docs, base, least=0.7)[0].collect()}
    want = {(d, m.start(), m.end()) for d, t, _ in rows for w, name in strong if name in t for m in re.finditer(rf"(?i)(?<![^\W_]){w}(?![^\W_])", t)}
    got = {(r.doc_id, r.start, r.end) for r in pii.disclosing_terms(docs, base, threshold=0.7).collect()}
    assert got == want


def test_generalised_terms_get_their_class(spark):
    rows = [(k, f"{passage(12, k)} Ask Quimby, badge 7731, at zq@corp.example {passage(9, 50 + k)}", "x") for k in range(4)] + [(10 + k, f"Ask him, badge {k}, at u{k}@corp.example {passage(9, 90 + k)}", "x") for k in range(40)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, SCHEMA), generalise=True).collect()}
    assert all("Ask [NAME], badge [NUMBER], at [EMAIL]" in got[k] for k in range(4))



def test_warc_files_are_plain_zstandard_with_distinct_ids(spark, tmp_path):
    """A standard decoder with the leading frame's dictionary reads each file to its end; ids differ, revisits refer to one."""
    import pathlib
    import struct

    import zstandard

    same = "<p>" + "repeated page " * 30 + "</p>"
    rows = [(k, f"http://h/{k}", same if k % 3 == 0 else f"<p>page {k} {passage(20, k)}</p>") for k in range(60)] + [(3, "http://again", same), (0, "http://again", same), (None, None, same), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages, f"file://{tmp_path}/w", archive_bytes=3000).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    canonical = {r.record_id for r in got if r.page_id == 0 and r.record_type == "response"}
    assert {r.refers_id for r in got if r.record_type == "revisit"} <= canonical and len(canonical) == 2
    read = b""
    for path in pathlib.Path(tmp_path, "w").glob("part-*"):
        data = path.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
        read += zstandard.ZstdDecompressor(dict_data=known).stream_reader(data[8 + size :], read_across_frames=True).read()
    assert read.count(b"WARC/1.1\r\n") == len(rows)


def test_sets_with_a_common_passage_only_make_no_pairs(spark):
    """Documents that share a passage and little else meet by its tokens; parity maps keep them from leaving rows."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    own = {k: passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(70)) for k in range(120)}
    near = {k: " ".join(w if rng.random() > 0.01 else "x" for w in own[k - 1000].split()) for k in range(1000, 1030)}
    docs = spark.createDataFrame([*own.items(), *near.items()], "doc_id long, text string")
    heads = simhash.shingle_heads(docs, 5, 0.8, simhash.common_shingles(docs, 5), 0, 3)
    leads = heads.select(F.col("doc_id").alias("id"), "size", F.col("doc_id").alias("part"), "m1", "m2", F.posexplode("lead").alias("place", "token"))
    sets = {k: {" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for k, t in (own | near).items() for x in (t.split(),)}
    want = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    met = {(r.a, r.b) for r in simhash._meetings(leads, 0.8, False).collect()}
    assert len(want) > 10 and want <= met and len(met) < 2 * len(want)
