"""Exact top-k inner products by KD-trees, one for each shard of the vectors.

A tree halves its shard at the median of the widest side, down to small leaves, and keeps each node's tight box. For a
query no vector of a box scores more than the sum of its best corner's products, so nodes are taken best bound first,
and a search ends when the best bound left is below the k-th score. That score goes on from shard to shard: each query
first searches one shard, then takes what it found there to groups of the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import cut
from foliant.llm.vectors import whole

#: Vectors of a leaf; bytes of a shard's vectors and of a block's queries; at most so many shards, and blocks, meet in one group.
LEAF = 128
SHARD_BYTES, BLOCK_BYTES = 1 << 20, 1 << 16
GROUP = 8
_LEAST = -(1 << 63)


class Tree:
    """A KD-tree over rows of whole numbers: nodes with tight boxes, kids by number, and ranges of the reordered rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.kids: list[tuple[int, int] | None] = []
        self.range: list[tuple[int, int]] = []
        self._boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(points, 0, len(points), leaf)
        self.points = points[self.order]
        self.low, self.high = (np.array(x) for x in zip(*self._boxes, strict=True))

    def _grow(self, points: np.ndarray, start: int, end: int, leaf: int) -> int:
        mine = points[self.order[start:end]]
        number, low, high = len(self.range), mine.min(axis=0), mine.max(axis=0)
        self._boxes.append((low, high))
        self.range.append((start, end))
        self.kids.append(None)
        side = int(np.argmax(high - low))
        if end - start > leaf and high[side] > low[side]:  # equal vectors stay in one leaf
            middle = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(mine[:, side], middle)]
            self.kids[number] = (self._grow(points, start, start + middle, leaf), self._grow(points, start + middle, end, leaf))
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest score that a vector of each node's box could have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


class Best:
    """The k best of one query so far: scores descending, then ids, then row numbers ascending."""

    def __init__(self, k: int, bound: int = _LEAST) -> None:
        self.k, self.bound = k, bound
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        some = score >= self.bound
        if not some.any():
            return
        rows = np.concatenate([self.rows, np.column_stack([score[some], ids[some], numbers[some]])])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.k]
        self.rows = rows
        if len(rows) == self.k:
            self.bound = max(self.bound, int(rows[-1, 0]))


def search(tree: Tree, ids: np.ndarray, numbers: np.ndarray, queries: np.ndarray, own: np.ndarray, found: list[Best]) -> int:
    """Adds a shard's vectors to each query's best, but for the query's own row; gives the number of scores computed.

    A bound equal to the k-th score is still followed, since a smaller id wins a tie.
    """
    bounds, computed = tree.bounds(queries), 0
    for q, best in enumerate(found):
        heap = [(-int(bounds[q, 0]), 0)]
        while heap and -heap[0][0] >= best.bound:
            _, node = heapq.heappop(heap)
            if tree.kids[node] is None:
                part = slice(*tree.range[node])
                score = (tree.points[part] @ queries[q]).astype(np.int64)
                computed += len(score)
                which = numbers[part]
                there = which != own[q]
                best.add(score[there], ids[part][there], which[there])
            else:
                for kid in tree.kids[node]:
                    if bounds[q, kid] >= best.bound:
                        heapq.heappush(heap, (-int(bounds[q, kid]), kid))
    return computed


def _exact(numbers: np.ndarray, width: int, largest: int) -> np.ndarray:
    """As doubles where every sum of products is exact in them, else as 64-bit integers."""
    return numbers.astype(np.float64 if largest * largest * max(width, 1) < 1 << 53 else np.int64)


#: A shard or a block: the ids, row numbers and vectors of its rows, and the largest component.
_PART = pa.schema([("ids", pa.binary()), ("numbers", pa.binary()), ("v", pa.binary()), ("largest", pa.int64())])
#: A block after its first search: the queries' k-th scores, and what was found.
_BLOCK = pa.schema([("part", pa.int32()), *_PART, ("kth", pa.binary()), ("hits", pa.binary())])
_HITS = pa.schema([(n, pa.int64()) for n in ("number", "query_id", "vec_id", "candidate", "score")])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (id, v, number) dealt out evenly to this many parts, each packed as one row; part counts from 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[list[bytes]] = [[], [], []]
        for batch in batches:
            for cell, name in zip(cells, ("id", "number"), strict=False):
                cell.append(batch.column(name).to_numpy().astype("<i8").tobytes())
            cells[2] += batch.column("v").to_pylist()
        ids, numbers, v = (b"".join(c) for c in cells)
        largest = int(np.abs(np.frombuffer(v, "<i4").astype(np.int64)).max(initial=0))
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((ids, numbers, v, largest), _PART, strict=True)], schema=_PART)

    packed = rows.select("id", "v", "number").repartition(parts).mapInArrow(pack, _ddl(_PART))
    return cut(packed.withColumn("part", F.spark_partition_id()))


def _columns(hits: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c) for c in np.ascontiguousarray(hits.reshape(-1, len(_HITS)).T)], schema=_HITS)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose id ``every`` divides.

    A query meets all rows but its own; ties go to the smaller id. Null vectors, and those with null or non-finite
    components, take no part, neither do rows without an id. Vectors of unequal length meet as if the shorter one ended
    in zeros. A repeated row is a candidate, and a query, of its own. Fewer candidates than k give fewer rows.

    Shards and blocks of queries are rows of bounded size, and each pair of them meets once, up to ``GROUP`` by
    ``GROUP`` in a task. So a task holds some ten MB at any table size; shuffled are the queries once for each group
    of shards, and the shards once for each group of blocks.
    """
    width = max(1, vectors.agg(F.max(F.size(F.col(column)))).first()[0] or 1)
    rows = cut(whole(vectors, id_column, column, scale, width=width).where("id is not null")).withColumn("number", F.monotonically_increasing_id())
    asks = F.col("id") % every == 0
    n, asked = rows.agg(F.count("*"), F.count_if(asks)).first()
    n_shards, n_blocks = (max(1, -(-count // max(1, size // (4 * width)))) for count, size in ((n, SHARD_BYTES), (asked, BLOCK_BYTES)))
    shards, blocks = _parts(rows, n_shards), _parts(rows.where(asks), n_blocks)

    def opened(row: dict, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, numbers = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["numbers"], "<i8")
        return ids, numbers, _exact(np.frombuffer(row["v"], "<i4").reshape(len(ids), width), width, largest)

    def searched(shard_rows: pa.Table, block_rows: pa.Table, first: bool) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """(block, k-th scores, hits) after all shards of the group, one by one; later on without a block's own first shard."""
        largest = max(max(t.column("largest").to_pylist()) for t in (shard_rows, block_rows))
        trees = []
        for row in shard_rows.to_pylist():
            ids, numbers, points = opened(row, largest)
            if len(ids):
                tree = Tree(points)
                trees.append((row["part"], tree, ids[tree.order], numbers[tree.order]))
        for row in block_rows.to_pylist():
            ids, numbers, points = opened(row, largest)
            found = [Best(k, b) for b in ([_LEAST] * len(ids) if first else np.frombuffer(row["kth"], "<i8").tolist())]
            for part, tree, there, which in trees:
                if first or part != row["part"] % n_shards:
                    search(tree, there, which, points, numbers, found)
            own = np.repeat(np.arange(len(ids)), [len(b.rows) for b in found])
            hits = np.concatenate([np.zeros((0, 3), np.int64), *(b.rows for b in found)])
            yield row, np.array([b.bound for b in found], "<i8"), np.column_stack([numbers[own], ids[own], hits[:, 1], hits[:, 2], hits[:, 0]])

    def begin(shard_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
        done = [row | {"kth": kth.tobytes(), "hits": hits.astype("<i8").tobytes()} for row, kth, hits in searched(shard_rows, block_rows, True)] if block_rows.num_rows else []
        return pa.Table.from_pylist([{f.name: x[f.name] for f in _BLOCK} for x in done], schema=_BLOCK)

    def go_on(shard_rows: pa.Table, block_rows: pa.Table) -> pa.Table:
        return _columns(np.concatenate([hits for _, _, hits in searched(shard_rows, block_rows, False)]))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield from _columns(np.frombuffer(x, "<i8")).to_batches()

    home = F.pmod("part", F.lit(n_shards))
    begun = cut(shards.groupBy("part").cogroup(blocks.groupBy(home.alias("part"))).applyInArrow(begin, _ddl(_BLOCK)))
    per_shards, per_blocks = (min(GROUP, -(-count // GROUP)) for count in (n_shards, n_blocks))
    span = lambda count, per: F.explode(F.sequence(F.lit(0), F.lit((count - 1) // per)))
    left = shards.select("*", F.floor(F.col("part") / per_shards).cast("int").alias("s"), span(n_blocks, per_blocks).alias("b"))
    right = begun.drop("hits").select("*", F.floor(F.col("part") / per_blocks).cast("int").alias("b"), span(n_shards, per_shards).alias("s"))
    rest = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(go_on, _ddl(_HITS))
    hits = begun.select("hits").mapInArrow(unpack, _ddl(_HITS)).unionByName(rest)
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id", "candidate"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
