"""SimHash near-duplicates: fingerprints of whole texts, linked by a binary-trie self-join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, free, sized, slices, utf8
from foliant.llm.components import connected_components
from foliant.operators.ordering import ranked

_BITS = 64
#: Node pairs with at most this many leaf pairs are compared leaf by leaf.
_LEAVES = 64
#: Node pairs that are expanded at once; bounds a task's memory.
_FRONT = 1 << 18


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text: A-Z lower-cased, ASCII white space parts words, repeats stay.

    Fewer words than a shingle: the whole sequence is the only shingle. No word: no shingle.
    """
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(words) - shingle + 1)


def mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another hash of the same shingles; number 0 leaves them as they are."""
    if not number:
        return hashes
    z = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, prints: int = 1) -> DataFrame:
    """(doc_id, number, fp): fingerprints as signed 64-bit integers, ``prints`` for every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2048):
                hashes = (shingle_hashes(x, shingle) for x in utf8(batch.column(1)))
                found = np.array([[majority(mixed(h, k)) for k in range(prints)] for h in hashes], np.uint64).reshape(-1, prints)
                ids = pa.concat_arrays([batch.column(0)] * prints)
                number = np.repeat(np.arange(prints, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(found.T.ravel().view(np.int64))], names=["doc_id", "number", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, number int, fp long")


class _Sets:
    """Union-find over the leaves of a trie; the root of a set is its least leaf."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def flatten(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join the sets of each pair; returns those pairs that joined two sets, at most one for each leaf."""
        used_a, used_b = [a[:0]], [b[:0]]
        while len(a):
            self.flatten()
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, one = np.unique(np.maximum(x, y), return_index=True)
            self.root[high] = np.minimum(x, y)[one]
            used_a.append(a[one])
            used_b.append(b[one])
        return np.concatenate(used_a), np.concatenate(used_b)


def trie_links(keys: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within ``budget`` differing bits that connect the sorted distinct keys exactly as all such
    pairs would, where both ends agree in their first ``depth`` bits.

    A node of the trie is a range of the sorted keys. Pairs of nodes go down together, differing bits add up,
    and a pair over the budget is left. Smaller budgets go first: a pair of nodes that lie in one set by then
    has nothing to add, so a dense cluster doesn't cost the square of its size, and a link is reported only
    where it joins two sets.
    """
    n = len(keys)
    sets = _Sets(n)
    used: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    top = keys >> np.uint64(_BITS - depth) if depth else np.zeros(n, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if n else np.zeros(0, np.int64)
    last = np.append(first[1:], n)

    def same_set(lo: np.ndarray, hi: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        return breaks[hi - 1] == breaks[lo]

    for allowed in range(1, budget + 1):
        big = last - first > 1
        stack = [(first[big], last[big], first[big], last[big], np.zeros(big.sum(), np.int8), depth)]
        while stack:
            a0, a1, b0, b1, d, bit = stack.pop()
            if len(a0) > _FRONT:
                for at in range(0, len(a0), _FRONT):
                    stack.append(tuple(x[at : at + _FRONT] for x in (a0, a1, b0, b1, d)) + (bit,))
                continue
            root = sets.flatten()
            breaks = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
            done = same_set(a0, a1, breaks) & same_set(b0, b1, breaks) & (root[a0] == root[b0])
            a0, a1, b0, b1, d = (x[~done] for x in (a0, a1, b0, b1, d))
            if not len(a0):
                continue
            few = ((a1 - a0) * (b1 - b0) <= _LEAVES) | (bit >= _BITS)
            if few.any():
                w, h = (a1 - a0)[few], (b1 - b0)[few]
                each = np.repeat(np.arange(few.sum()), w * h)
                k = np.arange(len(each)) - np.repeat(np.cumsum(w * h) - w * h, w * h)
                x, y = a0[few][each] + k // h[each], b0[few][each] + k % h[each]
                near = (x < y) & (np.bitwise_count(keys[x] ^ keys[y]) <= allowed)
                used.append(sets.link(x[near], y[near]))
                a0, a1, b0, b1, d = (v[~few] for v in (a0, a1, b0, b1, d))
            if not len(a0):
                continue
            one = np.uint64(1 << (_BITS - 1 - bit))
            middle = lambda lo: np.searchsorted(keys, (keys[lo] | one) & ~(one - np.uint64(1)))  # noqa: B023, E731
            am, bm, twin = np.clip(middle(a0), a0, a1), np.clip(middle(b0), b0, b1), a0 == b0
            parts = ((a0, am, b0, bm, d, True), (am, a1, bm, b1, d, True), (a0, am, bm, b1, d + 1, True), (am, a1, b0, bm, d + 1, ~twin))
            kept = [(lo < hi) & (lo2 < hi2) & (e <= allowed) & use for lo, hi, lo2, hi2, e, use in parts]
            stack.append(tuple(np.concatenate([p[i][k] for p, k in zip(parts, kept, strict=True)]) for i in range(5)) + (bit + 1,))
    return np.concatenate([a for a, _ in used]), np.concatenate([b for _, b in used])


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """(number, a, b): links among distinct fingerprints (number, fp) that connect all pairs of one number within
    the budget.

    Cut into budget + 1 equal blocks, two fingerprints within the budget agree in one block at least. So each
    fingerprint goes once for each block to the trie that has this block's bits on top, and tries are dealt out
    by those bits: no pair of fingerprints within the budget is missed, and a shuffle row is a few bytes.
    """
    blocks = budget + 1
    width = _BITS // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            number, turn, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            both = number.astype(np.int64) * blocks + turn
            for t in np.unique(both).tolist():
                got.setdefault(divmod(t, blocks), []).append(fp[both == t])
        for (number, t), parts in got.items():
            shift = np.uint64(t * width)
            turned = np.concatenate(parts)
            keys = np.unique(turned << shift | turned >> (np.uint64(_BITS) - shift) if t else turned)
            a, b = (keys[x] for x in trie_links(keys, width, budget))
            back = (lambda x, s=shift: x >> s | x << (np.uint64(_BITS) - s)) if t else (lambda x: x)
            for at in range(0, len(a), 65536):
                own = [pa.array(back(x[at : at + 65536]).view(np.int64)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), number, np.int32)), *own], names=["number", "a", "b"])

    turns = distinct.select("number", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("turn"), "fp")
    rotated = F.expr(f"shiftleft(fp, turn * {width}) | if(turn = 0, 0L, shiftrightunsigned(fp, {_BITS} - turn * {width}))")
    head = F.shiftrightunsigned(rotated, _BITS - width)
    return turns.withColumn("head", head).repartition("number", "turn", "head").select("number", "turn", "fp").mapInArrow(run, "number int, a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Two documents link if their fingerprints differ in at most ``budget`` bits; component_id is the least doc_id
    reachable. Texts that are null, empty or without a word have fingerprint 0 and link like any other. Copies
    share a fingerprint and enter the join once, so groups of any size cost their distinct fingerprints only.
    Repeated rows of one doc_id stay rows. A row without doc_id links its neighbours but can't name a component;
    where no member has a doc_id, component_id is null. Other columns are ignored. No row in, no row out.
    """
    marked = cut(fingerprints(docs, shingle).drop("number"))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = connected_components(links(classes.withColumn("number", F.lit(0)), budget), "a", "b").withColumnRenamed("node", "fp")
    named = classes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = cut(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents whose shingles are counted to find the common ones: so many, or one in a hundred; and the most common ones that are kept.
_SAMPLE, _SHARE, _COMMON = 10_000, 100, 1 << 17
#: A token's group of up to so many rows is paired step by step, a larger one part by part.
_STEPS = 256
#: The least hashes of a set by which the first round of links meets.
_FIRST = 4
#: Bits of a set's parity map: two sets differ in at least as many tokens as their maps differ in bits.
_MAP = 128


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, ascending, with their counts there; the sample grows with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256):
                sets = [np.unique(shingle_hashes(x, shingle)) for x in utf8(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["token"])

    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(min(1, max(_SAMPLE, n / _SHARE) / max(n, 1)) * (1 << 30)))
    tokens = chosen.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long")
    found = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "token").limit(_COMMON).toArrow()
    token, n = found.column("token").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, s): the distinct shingle hashes of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 512):
                sets = [np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in utf8(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, s array<long>")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def shingle_heads(docs: DataFrame, shingle: int, share: float, common: tuple[np.ndarray, np.ndarray], prints: int, print_shingle: int) -> DataFrame:
    """What finds a row's partners, without its whole set: its size, a 128-bit hash (k1, k2) of it, its ``least``
    hashes, its ``lead`` (as many tokens, rare ones first, as every partner of that share must meet), its
    fingerprints ``fps`` and its parity map (m1, m2): each bit tells whether the number of tokens that fall on it is odd."""
    known, counts = (np.append(x, 0) for x in common)

    def head(text: bytes) -> tuple:
        own = np.unique(shingle_hashes(text, shingle))
        signed = own.view(np.int64)
        at = np.searchsorted(known[:-1], signed)
        count = np.where((known[at] == signed) & (at < len(known) - 1), counts[at], 0)
        lead = signed[np.lexsort((signed, count))][: len(own) - int(np.ceil(len(own) * share * (1 - 1e-9))) + 1]
        digest = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64)
        hashes = shingle_hashes(text, print_shingle) if prints else own
        fps = np.array([majority(mixed(hashes, k)) for k in range(prints)], np.uint64).view(np.int64)
        odd = np.bincount((own & np.uint64(_MAP - 1)).astype(np.int64), minlength=_MAP) & 1
        m1, m2 = np.packbits(odd.astype(bool)).view(np.int64)
        return len(own), digest[0], digest[1], m1, m2, np.sort(signed)[:_FIRST], lead, fps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "size", "k1", "k2", "m1", "m2", "least", "lead", "fps"]
        for whole in batches:
            for batch in slices(whole, 512):
                size, *longs = columns = list(zip(*map(head, utf8(batch.column(1))), strict=True))
                longs, lists = longs[:4], columns[5:]
                plain = [pa.array(np.array(size, np.int32)), *(pa.array(np.array(x)) for x in longs)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *plain, *map(_lists, lists)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size int, k1 long, k2 long, m1 long, m2 long, least array<long>, lead array<long>, fps array<long>")


def texts_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) with one row for each text of each doc_id, and (node, doc_id, text) of the ids that repeat.

    Of several texts under one id the least goes by the id itself; each other one gets a number of its own beyond all
    ids, its ``node``, so it is a document like others. Only texts whose id repeats are shuffled, in places that don't
    depend on how many texts an id has. Rows without doc_id don't come.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = sized(cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")), 200_000)
    least, most = rows.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    several = cut(ranked(rows.join(repeated, "doc_id", "left_semi").distinct(), "doc_id", "text"))
    beyond = F.lit(most) + 1 + F.monotonically_increasing_id() if most < 1 << 62 else F.lit(least) - 1 - F.monotonically_increasing_id()
    known = cut(several.select(F.when(F.col("place") == 0, F.col("doc_id")).otherwise(beyond).alias("node"), "doc_id", "text"))
    single = rows.join(repeated, "doc_id", "left_anti")
    return single.unionByName(known.select(F.col("node").alias("doc_id"), "text")), known


def _meetings(rows: DataFrame, share: float, neighbours: bool) -> DataFrame:
    """(a, b), a > b: members of one token's group (token, size, place, id, part, m1, m2) whose sizes, places and parity maps allow the share.

    ``neighbours``: only those next to each other by size. Otherwise rows must hold whole leads, and a pair must share
    enough of them: of two sets, the one whose lead ends first in the order of tokens has whatever it shares up to
    there in both leads, so the overlap is at most the shared leads and what follows the lead of the larger set.
    Members of one part are no pair. Nor are two sets whose maps differ in more bits than the tokens in which sets of that
    share may differ: sets with a common passage and little else meet by its tokens, but leave no row. Tokens come sorted; of a token that goes on in the next batch, the rows wait
    for it.
    """

    def fitting(token: np.ndarray, size: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (smaller, larger) of one token, of different parts, whose sizes allow the share. A part's rows never
        meet each other, so a group of copies costs nothing, and one with a few strangers costs theirs only."""
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        length = np.repeat(np.diff(edges), np.diff(edges))
        low, step = np.flatnonzero((length <= _STEPS) | neighbours), 0
        while True:
            step += 1
            low = low[low + step < len(token)]
            high = low + step
            fit = (token[low] == token[high]) & (size[low] >= share * size[high] * (1 - 1e-9))
            low, high = low[fit], high[fit]
            if not len(low):
                break
            apart = part[low] != part[high]
            yield low[apart], high[apart]
            if neighbours:
                return
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j - i <= _STEPS:
                continue
            _, of, n = np.unique(part[i:j], return_inverse=True, return_counts=True)
            rank = np.argsort(np.argsort(n, kind="stable"), kind="stable")[of]  # parts by their number of rows
            order = np.argsort(rank, kind="stable")
            start = np.searchsorted(rank[order], np.arange(len(n)), side="right")
            for x, after in zip(order, start[rank[order]], strict=True):
                rest = order[after:]  # rows of larger parts
                x, rest = x + i, rest + i
                rest = rest[np.minimum(size[x], size[rest]) >= share * np.maximum(size[x], size[rest]) * (1 - 1e-9)]
                if len(rest):
                    first = size[x] <= size[rest]
                    yield np.where(first, x, rest), np.where(first, rest, x)

    def pairs(token: np.ndarray, size: np.ndarray, place: np.ndarray, ids: np.ndarray, part: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> Iterator[pa.RecordBatch]:
        maps = [m.view(np.uint64) for m in (m1, m2)]
        waiting, n_waiting = [], 0
        for x, y in itertools.chain(fitting(token, size, part), [(None, None)]):
            if x is not None:
                apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in maps)
                near = apart <= (1 - share) / (1 + share) * (size[x] + size[y]) * (1 + 1e-9)
                x, y = x[near], y[near]
            if x is not None and len(x):
                waiting.append((x, y))
                n_waiting += len(x)
            if waiting and (x is None or n_waiting >= 1 << 18):
                yield from met_rows(*(np.concatenate(c) for c in zip(*waiting, strict=True)), size, place, ids)
                waiting, n_waiting = [], 0

    def met_rows(x: np.ndarray, y: np.ndarray, size: np.ndarray, place: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        least = share / (1 + share) * (size[x] + size[y]) * (1 - 1e-9)
        early = np.minimum(size[x] - place[x], size[y] - place[y]) >= least
        need = np.ones(len(x)) if neighbours else np.ceil(least - np.ceil(size[y] * share * (1 - 1e-9)) + 1)
        ends = np.stack([np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])], axis=1)
        both, one, which, n = np.unique(ends, axis=0, return_index=True, return_inverse=True, return_counts=True)
        columns = [both[:, 0].copy(), both[:, 1].copy(), n, need[one].astype(np.int64), np.bincount(which.ravel(), early, len(both)) > 0]
        for at in range(0, len(both), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536]) for c in columns], names=["a", "b", "n", "need", "early"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            last = held[-1][0][-1]
            if held[0][0][0] != last:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                done = int(np.flatnonzero(whole[0] != last)[-1]) + 1
                yield from pairs(*(c[:done] for c in whole))
                held = [[c[done:] for c in whole]]
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))

    if "m1" not in rows.columns:  # without maps nothing is left out by them
        rows = rows.withColumns({"m1": F.lit(0).cast("long"), "m2": F.lit(0).cast("long")})
    met = rows.repartition("token").sortWithinPartitions("token", "size", "id").select("token", "size", "place", "id", "part", "m1", "m2")
    found = met.mapInArrow(run, "a long, b long, n long, need long, early boolean")
    counted = found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("early").alias("early"))
    return counted.where("early and n >= need").select("a", "b")


def _fingerprint_pairs(rows: DataFrame, budget: int) -> DataFrame:
    """(a, b): links of the fingerprints ``fps`` of rows (doc_id, fps), as pairs of documents, a > b.

    Documents of one fingerprint link to the least of them; of two fingerprints within the budget, the least
    documents link.
    """
    marked = rows.select("doc_id", F.posexplode("fps").alias("number", "fp"))
    classes = cut(marked.groupBy("number", "fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    same = marked.join(classes.where("n > 1"), ["number", "fp"]).select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    ends = [classes.select("number", F.col("fp").alias(e), F.col("first_id").alias(f"{e}_id")) for e in "ab"]
    near = links(classes.select("number", "fp"), budget).join(ends[0], ["number", "a"]).join(ends[1], ["number", "b"])
    both = same.unionByName(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return both.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def alike(docs: DataFrame, shingle: int, share: float, prints: int = 2, budget: int = 4, print_shingle: int = 3) -> DataFrame:
    """(a, b): links that connect documents exactly as all pairs would that share ``share`` of their distinct shingles.

    Texts of equal shingles are one class. First the trie join of the classes' ``prints`` SimHash fingerprints
    proposes pairs within ``budget`` bits, and every pair is tested on its whole sets before it links. A fingerprint
    misses a part of the pairs near the bound, so an exact check follows for what isn't linked by then: two sets of
    a share of t or more have a token in common within the first n - t n + 1 of each, in any order of tokens that is
    the same for all; rare tokens go first, so that groups stay small, and places and sizes exclude further pairs.
    Pairs that verified links have joined aren't tested again, so a dense cluster doesn't cost its square.
    docs: (doc_id, text), each doc_id once, as texts_apart() gives them.
    """
    one = docs
    heads = cut(shingle_heads(one, shingle, share, common_shingles(one, shingle), prints, print_shingle))
    classes = heads.groupBy("size", "k1", "k2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    again = heads.select("doc_id", "size", "k1", "k2").join(classes.where("n > 1"), ["size", "k1", "k2"])
    equal = cut(again.where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    own = heads.join(sized(equal.select(F.col("a").alias("doc_id")), 200_000), "doc_id", "left_anti")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets have the share; sets are made anew, of the texts on some pair only."""
        pairs = cut(pairs)
        touched = sized(cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), 200_000)
        few = shingle_sets(one.join(touched, "doc_id", "left_semi"), shingle)
        left, right = (few.select(F.col("doc_id").alias(e), F.col("s").alias(f"s{e}")) for e in "ab")
        both = pairs.join(left, "a").join(right, "b")
        both_have = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - both_have
        return cut(both.where((union == 0) | (both_have >= share * union)).select("a", "b"))

    least = own.select(F.col("doc_id").alias("id"), "size", F.col("doc_id").alias("part"), F.lit(0).alias("place"), "m1", "m2", F.explode("least").alias("token"))
    proposed = _meetings(least, share, True)
    if prints:
        proposed = _fingerprint_pairs(own, budget).unionByName(proposed).distinct()
    near = verified(proposed)
    joined = sized(cut(connected_components(near, "a", "b").withColumnRenamed("node", "doc_id")), 200_000)
    parted = own.join(joined, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    leading = parted.select(F.col("doc_id").alias("id"), "size", "part", "m1", "m2", F.posexplode("lead").alias("place", "token"))
    rest = verified(_meetings(leading, share, False))
    return equal.unionByName(near).unionByName(rest)


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 3, prints: int = 1, check: tuple[int, float] | None = None) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group; rows without doc_id stay.

    Documents are linked if any of their ``prints`` fingerprints, which hash the same shingles differently, are
    within the budget. ``check`` = (words, share) links exactly the texts that share that part of their distinct
    shingles of so many words: fingerprints propose, every pair is tested itself, and an exact check finds the pairs
    that no fingerprint proposed, so that no pair of that share stays.
    Null and empty texts have no shingle and are copies of each other. Several texts under one doc_id are documents of
    their own, so a text that has no copy stays whatever shares its id; rows that repeat both are one document and stay
    or go together. Other columns stay; an empty table stays empty.
    """
    one, several = texts_apart(docs)
    if check:
        pairs = alike(one, *check, prints, budget, shingle)
    else:
        marked = cut(fingerprints(one, shingle, prints))
        classes = cut(marked.groupBy("number", "fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
        members = marked.join(classes.where("n > 1"), ["number", "fp"]).where("doc_id != first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
        near = links(classes.select("number", "fp"), budget)
        ends = [classes.select("number", F.col("fp").alias(e), F.col("first_id").alias(f"{e}_id")) for e in "ab"]
        across = near.join(ends[0], ["number", "a"]).join(ends[1], ["number", "b"]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        pairs = cut(members.unionByName(across).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # The least doc_id of a group stays; a node beyond the ids stands for the id of its row.
    own = several.select("node", F.col("doc_id").alias("own_id"))
    found = cut(connected_components(pairs, "a", "b").join(own, "node", "left").withColumn("own_id", F.coalesce("own_id", "node")))
    first = found.groupBy("component").agg(F.min_by("node", F.struct("own_id", "node")).alias("first"))
    gone = cut(found.join(first, "component").where("node != first").select("node"))
    rows = docs.join(sized(gone.join(own, "node", "left_anti").withColumnRenamed("node", "doc_id"), 200_000), "doc_id", "left_anti")
    i, t = free(docs.columns, "id", "body")
    texts = sized(cut(several.join(gone, "node", "left_semi").select(F.col("doc_id").alias(i), F.col("text").alias(t))), 20_000)
    return rows.join(texts, (F.col("doc_id") == F.col(i)) & F.col("text").cast("string").eqNullSafe(F.col(t)), "left_anti").select(*docs.columns)
