"""Merkle manifest of a table: a hash tree for each language, one root, and a proof for every row.

The rank of a leaf in base 8 says where it hangs. A rollup groups the last digit away, then the next, and so on inside
a block of 512 leaves, and nests the children of a node as an array of structs. Blocks' hashes are the leaves of the
next rollup, until each language has one node; the languages' nodes are rolled up in the same way. On the way back a
block's nested row gets the proof of its own place as one more row of the group, and transform and explode give each
child its siblings: no join is needed, and no row holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut
from foliant.operators.ordering import ranked

FAN = 8
#: Digits that one rollup groups away: a block has FAN ** DIGITS leaves at most.
DIGITS = 3
_BLOCK = FAN**DIGITS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _node_count(n: Column, level: int) -> Column:
    """Nodes at a level over n leaves."""
    return F.ceil(n / F.lit(FAN**level)).cast("long")


def _digits(nodes: DataFrame) -> DataFrame:
    """nodes: tree, place, n, hash, and what else; the place becomes a block and the digits d0 (last) to d2."""
    digits = {f"d{k}": F.pmod(F.shiftright("place", 3 * k), F.lit(FAN)).cast("int") for k in range(DIGITS)}
    return nodes.withColumns({"block": F.shiftright("place", 3 * DIGITS), **digits}).drop("place")


def _rollup(rows: DataFrame, node: Column) -> DataFrame:
    """(tree, block, n, hash, kids, up): nested nodes of each block. rows: _digits(), and up, which only rows of their own have.

    A level whose language has a single node left isn't hashed again. Only the first step moves rows: the later
    groupings are on more columns than those that the rows are dealt out by.
    """
    rows = rows.repartition("tree", "block").select("tree", "block", "n", *(f"d{k}" for k in range(DIGITS)), node.alias("node"), "up")
    for k in range(DIGITS):
        left = [f"d{j}" for j in range(k + 1, DIGITS)]
        child = F.when(F.col("node").isNotNull(), F.struct(f"d{k}", "node"))
        grouped = rows.groupBy("tree", "block", *left).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(child)).alias("kids"), F.any_value("up", True).alias("up"))
        hashes = F.transform("kids", lambda x: x["node"]["hash"])
        hashed = F.when(_node_count(F.col("n"), k) > 1, sha(F.array_join(hashes, ""))).otherwise(hashes[0])
        made = F.when(F.size("kids") > 0, F.struct(hashed.alias("hash"), F.col("kids")))
        rows = grouped.select("tree", "block", "n", *left, made.alias("node"), "up")
    return rows


def _placed(kids: Column) -> Column:
    """Each child with the hashes of its siblings before and after it."""
    hashes = F.transform(kids, lambda x: x["node"]["hash"])

    def one(kid: Column, i: Column) -> Column:
        before, after = F.slice(hashes, F.lit(1), i), F.slice(hashes, i + 2, F.lit(FAN))
        return F.struct(kid["node"].alias("node"), F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")).alias("step"))

    return F.transform(kids, one)


def _emit(blocks: DataFrame) -> DataFrame:
    """(tree, n, node, up): the nodes that the blocks were made of, each with the steps of its own proof.

    up is a struct of steps (from the node to the root: the siblings before and after it), subroot and root.
    """
    rows = blocks
    for k in reversed(range(DIGITS)):
        opened = rows.select("tree", "n", "up", F.explode(_placed(F.col("node.kids"))).alias("kid"))
        own = F.when(_node_count(F.col("n"), k) > 1, F.array(F.col("kid.step"))).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
        up = F.struct(F.concat(own, F.col("up.steps")).alias("steps"), F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"))
        rows = opened.select("tree", "n", F.col("kid.node").alias("node"), up.alias("up"))
    return rows


_UP = "struct<steps:array<struct<before:string,after:string>>,subroot:string,root:string>"


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above nodes (tree, place, n, hash), block by block; the last has one node for each tree. most: nodes of the largest tree."""
    levels = []
    while most > 1 or not levels:
        rows = _digits(nodes.select("tree", "place", "n", "hash")).withColumn("up", F.lit(None).cast(_UP))
        made = _rollup(rows, F.struct("hash"))
        nodes = cut(made.select("tree", F.col("block").alias("place"), _node_count(F.col("n"), DIGITS).alias("n"), F.col("node.hash").alias("hash")))
        levels.append(nodes)
        most = -(-most // _BLOCK)
    return levels


def _descend(nodes: DataFrame, ups: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, hash, payload, up) of nodes (tree, place, n, hash, payload). ups: (tree, place, up) of the blocks they are in."""
    load = F.struct("hash", F.struct(*payload).alias("load"))
    rows = _digits(nodes.select("tree", "place", "n", load.alias("own"))).withColumn("up", F.lit(None).cast(_UP))
    above = ups.select("tree", F.col("place").alias("block"), "up")
    opened = _emit(_rollup(rows.unionByName(above, allowMissingColumns=True), F.col("own")))
    return opened.select("tree", F.col("node.hash").alias("hash"), *(F.col(f"node.load.{x}").alias(x) for x in payload), "up")


def _proofs(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, payload: list[str]) -> DataFrame:
    """Goes down from the trees' last level, whose nodes have their ups in tops (tree, place 0, up)."""
    ups = tops
    for level in reversed(levels[:-1]):
        ups = cut(_descend(level.withColumn("at", F.col("place")), ups, ["at"]).select("tree", F.col("at").alias("place"), "up"))
    return _descend(nodes, ups, payload)


def authenticate(leaves: DataFrame, tree: str, leaf: str, *order: Column | str) -> DataFrame:
    """The rows with ``subroot``, ``root`` and ``steps``: the siblings before and after, level by level up to the root.

    leaves: a row for each leaf, with its hash as hexadecimal text in ``leaf`` and the tree that it belongs to; null is
    a tree like others, and stands first. Leaves of a tree ascend by ``order``, then by hash; rows that are equal there
    have the same hash, so their order doesn't matter. Trees stand in the order of their names' UTF-8 bytes. A tree with
    one leaf has it as its subroot, a single subroot is the root. A table without rows gives none.
    """
    rows = leaves.select(F.struct(*leaves.columns).alias("row"), F.col(tree).alias("tree"), F.col(leaf).alias("hash"), *(F.col(o).alias(f"o{k}") if isinstance(o, str) else o.alias(f"o{k}") for k, o in enumerate(order)))
    nodes = cut(ranked(rows, "tree", *(f"o{k}" for k in range(len(order))), "hash").withColumnRenamed("group_rows", "n"))
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not most:
        none = F.lit(None).cast("string")
        return leaves.withColumns({"subroot": none, "root": none, "steps": F.lit(None).cast("array<struct<before:string,after:string>>")}).where(F.lit(False))
    levels = _climb(nodes, most)
    subroots = ranked(levels[-1].select(F.lit(None).cast("string").alias("tree"), "hash", F.col("tree").alias("name")), "tree", "name").withColumnRenamed("group_rows", "n")
    subroots = cut(subroots)
    above = _climb(subroots, subroots.count())
    root = above[-1].select("tree", "place", F.struct(F.array().cast("array<struct<before:string,after:string>>").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).cast(_UP).alias("up"))
    tops = _proofs(subroots, above, root, ["name"])
    tops = cut(tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("up").withField("subroot", F.col("hash")).alias("up")))
    done = _proofs(nodes, levels, tops, ["row"])
    return done.select("row.*", F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"), F.col("up.steps").alias("steps"))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's hash leads to with the siblings of a proof."""
    return F.aggregate(steps, leaf, lambda at, s: sha(F.concat(s["before"], at, s["after"])))


def proof_digest(steps: Column) -> Column:
    """One hash of all siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def document_leaf(text: Column) -> Column:
    """A leaf of documents, with this text in place of the row's own."""
    return sha(F.concat(*(field(x) for x in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text after the tampering that the check assumes: A-Z lower-cased where 3 divides the crc32 of the id; not where the id is null."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def audit(docs: DataFrame) -> DataFrame:
    """Every document with its leaf, its proof, and whether the tampered copy still leads to the root.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. Nulls, empty and very long texts are fields
    like others, repeated rows are leaves of their own.
    """
    text = F.col("text").cast("string")
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), document_leaf(text).alias("leaf"), document_leaf(tampered(F.col("doc_id"), text)).alias("seen"))
    proven = authenticate(leaves, "lang", "leaf", "doc_id")
    folded = proven.withColumn("folded_root", fold(F.col("seen"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
