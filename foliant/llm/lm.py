"""Language-model scores of whole texts from a word n-gram trie in sharded Elias-Fano levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, held_out, slices
from foliant.llm.eliasfano import Trie

_END = xxhash.xxh64_intdigest(b" end ")
_START = xxhash.xxh64_intdigest(b" start ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


class _Block:
    """The documents of some batches as one run of word codes; every document ends with the code of the end."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table.column(0)
        self.train = table.column(2).to_numpy()
        text = table.column(1).fill_null("").combine_chunks()
        words = pc.ascii_split_whitespace(pc.ascii_lower(text))
        values, offsets = words.flatten().dictionary_encode(), words.offsets.to_numpy() - words.offsets[0].as_py()
        names = values.dictionary.cast(pa.binary()).to_pylist()
        codes, owner = values.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(text)), np.diff(offsets))
        if b"" in names:
            real = codes != names.index(b"")
            codes, owner = codes[real], owner[real]
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((*map(digest, names), _END, _START), np.uint64, len(names) + 2)
        n = np.bincount(owner, minlength=len(text))
        ends = np.cumsum(n + 1) - 1
        self.code = np.full(len(codes) + len(text), len(names))
        self.doc = np.repeat(np.arange(len(text)), n + 1)
        inner = np.ones(len(self.code), bool)
        inner[ends] = False
        self.code[inner] = codes
        self.context = np.concatenate(([0], self.code[:-1]))
        self.context[ends - n] = len(names) + 1


def _blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[_Block]:
    held, size = [], 0
    for whole in batches:
        for batch in slices(whole, 512):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(1).fill_null(""))).as_py() // 6 + batch.num_rows
            if size >= tokens:
                yield _Block(held)
                held, size = [], 0
    if held:
        yield _Block(held)


def _pack(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: memoryview, kinds: list) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: Documents of the blob (id, flags, place in the block), words with the number of their rows, distinct contexts; then context and
#: document of every row, as bytes of the narrowest kind that holds them.
_KINDS = [np.int64, np.uint8, np.uint32, np.uint64, np.uint32, np.uint64, np.uint8, np.uint8]
#: A shard's sums for the documents of a block: place, tokens, known ones, base, score; then place, id and flags of
#: those whose end token lies in the shard, which is so in exactly one shard for each document.
_SUMS = [np.uint32, np.uint32, np.uint32, np.float64, np.float32, np.uint32, np.int64, np.uint8]


def _narrow(values: np.ndarray, most: int) -> np.ndarray:
    return values.astype(np.uint16 if most <= 1 << 16 else np.uint32).view(np.uint8)


def _wide(packed: np.ndarray, most: int) -> np.ndarray:
    return packed.view(np.uint16 if most <= 1 << 16 else np.uint32)


def unigrams(docs: DataFrame, block_tokens: int = 1_000_000) -> DataFrame:
    """(h, c): count of every training token by the XXH64 of its word. docs: (doc_id, text, train)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_tokens):
            n = np.bincount(block.code[block.train[block.doc]], minlength=len(block.hashes))
            seen = np.flatnonzero(n)
            for at in range(0, len(seen), 1 << 17):
                part = seen[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(block.hashes[part].view(np.int64)), pa.array(n[part])], names=["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def hot_pairs(docs: DataFrame, words: np.ndarray, bound: int, block_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count) of pairs in training texts whose count is over ``bound``; both ends are among ``words``, ascending.

    A pair is no more frequent than its ends, so only pairs of frequent words are counted; at most 1/bound of all
    tokens' number of pairs comes out, whatever the corpus.
    """
    known = np.sort(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_tokens):
            hot = np.isin(block.hashes, known)
            some = hot[block.code] & hot[block.context] & block.train[block.doc]
            pairs, n = np.unique(block.context[some] * len(block.hashes) + block.code[some], return_counts=True)
            columns = (block.hashes[pairs // len(block.hashes)].view(np.int64), block.hashes[pairs % len(block.hashes)].view(np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["v", "w", "c"])

    counted = docs.mapInArrow(run, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c")).where(F.col("c") > bound)
    found = counted.toArrow()
    v, w, c = (found.column(x).to_numpy() for x in ("v", "w", "c"))
    return v.view(np.uint64), w.view(np.uint64), c


def _pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a pair of hashes."""
    return (v * _MIX) ^ (w + (v >> np.uint64(7)))


def score_documents(docs: DataFrame, mu: float = 20_000.0, shard_tokens: int = 1_500_000, block_tokens: int = 1_000_000, least_shards: int = 64, parts: int = 7, part: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    The model is learned from all documents whose crc32(doc_id) mod ``parts`` is not ``part``. base_score is the
    add-one unigram score. score is the log10 probability under P(w | v) = (c(v w) + mu P1(w)) / (c(v) + mu), a
    bigram model with a Dirichlet prior on the add-one unigrams P1; each text begins after a start symbol.

    The numerator needs only counts of w, the denominator only counts of v. So every token goes once to the
    shard of its word, which has all that is known of the word: it builds the word's part of the trie (level 1:
    words; level 2: the contexts each was seen after), answers its own tokens and returns packed partial sums for
    the documents of each block, which are added up by block. Words with over a quarter of a shard's tokens
    (or 1/256 of all) are dealt to shards by context as well; there are at most four of these for each shard, and only
    their counts are broadcast. Pairs of such words with over a sixteenth of a shard's tokens (or 1/4096 of all) are
    counted first, and dealt to shards by block, which answer with the count that they are told. So no word and no pair
    outgrows its shard. Blocks go to shards as packed arrays with each distinct
    context once. Shards grow in number with the corpus (from ``least_shards`` on), not in size.

    Null texts and texts without a word have the end token only. Rows without doc_id count as the id text ''.
    Repeated rows are rows of their own. Without training rows all counts are zero. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held_out(F.col("doc_id"), parts, part)).alias("train"))
    counted = cut(unigrams(rows, block_tokens))
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counted.where(F.col("h") == F.lit(_END - 2**64 if _END >= 2**63 else _END)).first()
    starts = end.c if end else 0
    shards = max(least_shards, -(-int(total) // shard_tokens))
    bound = max(1, min(shard_tokens // 4, int(total) // 256))
    hot = {r.h & (2**64 - 1): r.c for r in counted.where(F.col("c") > bound).collect()}
    hot_words = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[h] for h in sorted(hot)], np.int64)
    ends = np.append(hot_words, np.uint64(_START))
    pair_v, pair_w, pair_n = hot_pairs(rows, ends, max(1, min(shard_tokens // 16, int(total) // 4096)), block_tokens) if len(hot_words) else (hot_words, hot_words, hot_counts)
    keys = _pair_keys(pair_v, pair_w)
    order = np.argsort(keys)
    pair_keys, pair_n = keys[order], pair_n[order]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, block in enumerate(_blocks(batches, block_tokens)):
            own = block.hashes % np.uint64(shards)
            to = own[block.code]
            if len(hot_words):
                spread = np.isin(block.hashes, hot_words)[block.code]
                mixed = (block.hashes[block.context[spread]] * _MIX) >> np.uint64(32)
                to[spread] = (mixed + to[spread]) % np.uint64(shards)
            if len(pair_keys):
                apart = np.flatnonzero(spread)
                apart = apart[np.isin(_pair_keys(block.hashes[block.context[apart]], block.hashes[block.code[apart]]), pair_keys)]
                salt = (base + number) * int(_MIX) % (1 << 64) >> 32
                to[apart] = (to[apart] + np.uint64(salt)) % np.uint64(shards)
            order = np.argsort(to.astype(np.uint64) * np.uint64(len(block.hashes)) + block.code.astype(np.uint64), kind="stable")
            edges = np.searchsorted(to[order], np.arange(shards + 1))
            ids = np.array([0 if x is None else x for x in block.ids.to_pylist()], np.int64)
            flags = block.train.astype(np.uint8) + 2 * np.array([x is None for x in block.ids.to_pylist()], np.uint8)
            for shard in np.flatnonzero(np.diff(edges)).tolist():
                rows_ = order[edges[shard] : edges[shard + 1]]
                words, n = np.unique(block.code[rows_], return_counts=True)
                contexts, context = np.unique(block.context[rows_], return_inverse=True)
                documents, document = np.unique(block.doc[rows_], return_inverse=True)
                blob = _pack([ids[documents], flags[documents], documents.astype(np.uint32), block.hashes[words], n.astype(np.uint32), block.hashes[contexts], _narrow(context, len(contexts)), _narrow(document, len(documents))])
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([base + number]), pa.array([blob])], names=["shard", "block", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        docs_, flags, places, words, counts, contexts, context, document, sizes = [], [], [], [], [], [], [], [], [0]
        n_docs = n_contexts = 0
        for blob in table.column("blob"):
            a = _unpack(memoryview(blob.as_buffer()), _KINDS)
            for held, part in zip((docs_, flags, places, words, counts, contexts), a, strict=False):
                held.append(part)
            context.append(_wide(a[6], len(a[5])).astype(np.int32) + np.int32(n_contexts))
            document.append(_wide(a[7], len(a[0])).astype(np.int32) + np.int32(n_docs))
            n_docs, n_contexts = n_docs + len(a[0]), n_contexts + len(a[5])
            sizes.append(n_docs)
        docs_, flags, places, counts, context, document = map(np.concatenate, (docs_, flags, places, counts, context, document))
        root_names, root_of = np.unique(np.concatenate(words), return_inverse=True)
        context_names, context_of = np.unique(np.concatenate(contexts), return_inverse=True)
        del words, contexts
        root = np.repeat(root_of.astype(np.int32), counts)
        pair = root.astype(np.uint64) * np.uint64(len(context_names)) + context_of[context].astype(np.uint64)
        del context
        train = (flags & 1).astype(bool)[document]
        seen = np.bincount(root[train], minlength=len(root_names))
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, root_names), len(hot_words) - 1)
            seen = np.where(hot_words[at] == root_names, hot_counts[at], seen)
        asked, which = np.unique(pair, return_inverse=True)
        times = np.bincount(which[train], minlength=len(asked))
        asked_root = (asked // np.uint64(len(context_names))).astype(np.int64)
        if len(pair_keys):
            of = _pair_keys(context_names[(asked % np.uint64(len(context_names))).astype(np.int64)], root_names[asked_root])
            at = np.minimum(np.searchsorted(pair_keys, of), len(pair_keys) - 1)
            times = np.where(pair_keys[at] == of, pair_n[at], times)
        known = times > 0
        prior = mu * (seen + 1) / (total + distinct + 1)
        with Trie(len(root_names), len(context_names), asked[known], np.log10(prior), np.log10(times[known] + prior[asked_root[known]])) as trie:
            numerator = trie.values(asked_root, (asked % np.uint64(len(context_names))).astype(np.int64))
        base = np.log10(seen + 1)
        below = np.where(root_names == np.uint64(_END), np.log10(starts + mu), np.log10(seen + mu))
        n = np.bincount(document, minlength=n_docs).astype(np.uint32)
        known = np.bincount(document, seen[root] > 0, n_docs).astype(np.uint32)
        sums = np.bincount(document, base[root], n_docs)
        score = np.bincount(document, numerator[which] - below[root], n_docs).astype(np.float32)
        ends = np.zeros(n_docs, bool)
        ends[document[root_names[root] == np.uint64(_END)]] = True
        press, packed = zstandard.ZstdCompressor(level=1), []
        for i, j in zip(sizes[:-1], sizes[1:], strict=True):
            own = np.flatnonzero(ends[i:j]) + i
            packed.append(press.compress(_pack([places[i:j], n[i:j], known[i:j], sums[i:j], score[i:j], places[own], docs_[own], flags[own]])))
        return pa.table({"block": table.column("block"), "sums": pa.array(packed, pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        reader, parts = zstandard.ZstdDecompressor(), []
        for blob in table.column("sums"):
            parts.append(_unpack(memoryview(reader.decompress(blob.as_buffer())), _SUMS))
        place, ids, flags = (np.concatenate([p[k] for p in parts]) for k in (5, 6, 7))
        whole = np.zeros((4, int(place.max()) + 1))
        for p in parts:
            for k in range(4):
                np.add.at(whole[k], p[0], p[k + 1])
        n, known, base, score = whole[:, place]
        return pa.table({"doc_id": pa.array(ids, mask=(flags & 2).astype(bool)), "held_out": ~(flags & 1).astype(bool), "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base": base, "score": score})

    dealt = rows.mapInArrow(deal, "shard long, block long, blob binary")
    partial = dealt.groupBy("shard").applyInArrow(answer, "block long, sums binary")
    whole = partial.groupBy("block").applyInArrow(add_up, _FIELDS)
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), "score")
