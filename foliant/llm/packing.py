"""Lexical retrieval packing: token sequences filled with BM25 neighbours of a seed document."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_K1, _B = 1.2, 0.75


#: Runs of white space, or white space that isn't a space or a line feed: such texts are encoded whole.
_ODD_ASCII = bytes([9, 11, 12, 13, 28, 29, 30, 31])
_ODD = (b"  ", b" \n", b"\n ", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


#: Fixed value: the vocabulary's special token, which the tokenizer file maps to one id wherever a text has it.
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256


def _plain(text: bytes) -> bool:
    return bool(text) and _SPECIAL.encode() not in text and text[:1] != b" " and text[-1:] != b" " and not any(x in text for x in _ODD) and len(text.translate(None, _ODD_ASCII)) == len(text)


class Encoder:
    """Ids of the byte-level vocabulary of ``ranks_file``, equal to those of the tokenizer file that it mirrors.

    A space between two characters that are no white space always begins a token in this vocabulary's pattern.
    So the distinct words of a batch of plain texts are encoded once, as one text whose ids are dealt out to the
    words by their length in bytes, and then gathered; texts with other white space are encoded whole.
    """

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def _whole(self, text: str) -> np.ndarray:
        """Ids of one text; the special token parts it and has an id of its own."""
        parts = [self.encode(x) for x in text.split(_SPECIAL)]
        return np.array([*parts[0], *(i for x in parts[1:] for i in (_SPECIAL_ID, *x))], np.uint16)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, each with a space before it, and where each word's ids end."""
        ids = np.array(self.encode(" " + " ".join(words.to_pylist())), np.uint16)
        bytes_to = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        return ids, np.searchsorted(np.cumsum(self.sizes[ids]), bytes_to) + 1

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """texts: strings without nulls."""
        plain = np.array([_plain(x) for x in texts.cast(pa.binary()).to_pylist()], bool)
        out: list = [None] * len(texts)
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self._whole(texts[k].as_py())
        if plain.any():
            split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            values, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            codes, words = values.indices.to_numpy().astype(np.int64), values.dictionary
            ids, ends = self._table(words)
            first = [np.array(self.encode(words[k].as_py()), np.uint16) for k in codes[offsets[:-1] - offsets[0]].tolist()]
            codes[offsets[:-1] - offsets[0]] = len(words) + np.arange(len(first))
            ends = np.concatenate([ends, len(ids) + np.cumsum([len(x) for x in first])])
            ids = np.concatenate([ids, *first])
            size = np.diff(ends, prepend=0)
            each = size[codes]
            to = np.cumsum(each)
            flat = ids[np.repeat(ends[codes] - to, each) + np.arange(to[-1])]
            cuts = to[offsets[1:] - offsets[0] - 1]
            for k, own in zip(np.flatnonzero(plain).tolist(), np.split(flat, cuts[:-1]), strict=True):
                out[k] = own
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks_file: str | None = None, pattern: str | None = None) -> Encoder:
    import public_tokenizers

    name = ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name, pattern or public_tokenizers.PATTERN)
    return _ENCODERS[name]


class Index:
    """A shard's BM25 inverted index over token ids: postings sorted by term, scores as one array."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        length = np.array([len(x) for x in docs], np.int64)
        tokens = np.concatenate([np.zeros(0, np.uint16), *docs])
        order = np.argsort(tokens, kind="stable")  # by token, then by document
        token, owner = tokens[order], np.repeat(np.arange(len(docs), dtype=np.int32), length)[order]
        begins = np.flatnonzero(np.concatenate((np.ones(min(len(token), 1), bool), (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))))
        tf = np.diff(np.append(begins, len(token))).astype(np.float32)
        terms, self.owner = token[begins], owner[begins]
        self.first = np.searchsorted(terms, np.arange(65537))
        df = np.diff(self.first)
        self.idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = (_K1 * (1 - _B + _B * length / max(length.mean() if len(docs) else 1.0, 1.0))).astype(np.float32)
        self.weight, self.n = self.idf[terms] * tf * np.float32(_K1 + 1) / (tf + norm[self.owner]), len(docs)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard against the distinct terms of a query."""
        terms = np.unique(query)
        lo, n = self.first[terms], self.first[terms.astype(np.int64) + 1] - self.first[terms]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], self.weight[at], self.n)


class _Sequences:
    """Numbers sequences and collects their pieces."""

    def __init__(self, base: int) -> None:
        self.next, self.rows = base, []

    def add(self, pieces: list[tuple]) -> None:
        """pieces: (document, first id, ids) in order; a document is (doc_id, ids in all)."""
        offset = 0
        for doc, start, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc[0], start, len(ids), crc, doc[1], self.next, offset))
            offset += len(ids)
        self.next += 1

    def flush(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in names]
        self.rows, columns = [], [pa.array(list(x), pa.int64()) for x in columns]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _pack_shard(docs: list[tuple], out: _Sequences, window: int, query_terms: int, last: bool) -> list[tuple]:
    """Pack a shard's documents (doc_id, ids); returns what is left over for the next shard.

    Whole windows of a long document come first. A seed's window is then filled with its best unused neighbours;
    the neighbour that overflows is cut, and its rest seeds the next window, so that no window but the very last
    has a gap. That last one is cut into powers of two, which need no padding.
    """
    rests = []
    for doc_id, ids, start, total in docs:
        end = start + (len(ids) - start) // window * window
        for at in range(start, end, window):
            out.add([((doc_id, total), at, ids[at : at + window])])
        if end < len(ids):
            rests.append((doc_id, ids, end, total))
    index = Index([ids[at:] for _, ids, at, _ in rests])
    unused = np.ones(len(rests), bool)
    seeds = iter(np.argsort([-(len(ids) - at) for _, ids, at, _ in rests], kind="stable").tolist() if rests else [])
    pieces, room, carried = [], window, None
    while True:
        seed = carried
        if seed is None:
            seed = next((k for k in seeds if unused[k]), None)
            if seed is None:
                break
        carried = None
        queue = [seed]
        while queue and carried is None:
            k = queue.pop(0)
            doc_id, ids, at, total = rests[k]
            unused[k] = False
            take = min(room, len(ids) - at)
            pieces.append(((doc_id, total), at, ids[at : at + take]))
            room -= take
            if at + take < len(ids):
                rests[k] = (doc_id, ids, at + take, total)
                carried = k
            if not room:
                out.add(pieces)
                pieces, room = [], window
                break
            if not queue and unused.any():
                own = np.unique(rests[seed][1][rests[seed][2] :]) if len(rests[seed][1]) > rests[seed][2] else np.unique(ids)
                own = own[np.argsort(-index.idf[own], kind="stable")[:query_terms]]
                score = np.where(unused, index.scores(own), -1.0)
                best = np.argpartition(-score, min(32, len(score) - 1))[:32] if len(score) > 32 else np.arange(len(score))
                queue = [int(x) for x in best[np.lexsort((best, -score[best]))] if unused[x]]
    if not pieces:
        return []
    if not last:
        return [(doc[0], np.concatenate([np.zeros(start, np.uint16), ids]) if start else ids, start, doc[1]) for doc, start, ids in pieces]
    left = window - room
    while left:
        size, part = 1 << (left.bit_length() - 1), []
        need = size
        while need:
            doc, start, ids = pieces.pop(0)
            part.append((doc, start, ids[:need]))
            if len(ids) > need:
                pieces.insert(0, (doc, start + need, ids[need:]))
            need -= min(need, len(ids))
        out.add(part)
        left -= size
    return []


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, shard_tokens: int = 2_000_000, query_terms: int = 24, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of token sequences.

    A document is the token ids of its whole text, then ``end_id``; a null text counts as empty, so every row
    gives one id at least, and repeated rows are documents of their own. Each id lies in exactly one piece.
    Sequences hold ``window`` ids; only a partition's last ids go to shorter ones, each a power of two long.

    A partition reads its documents in shards of about ``shard_tokens`` ids (or one document, if longer). Each
    shard has a BM25 inverted index of its own; a seed's ``query_terms`` rarest terms fetch its unused
    neighbours, which greedily fill the seed's window. No text leaves its task, so nothing is shuffled, and a
    task's memory is bounded by the shard. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file, pattern)
        out, shard, held = _Sequences(TaskContext.get().partitionId() << 40), [], 0
        for whole in batches:
            for batch in slices(whole, 512):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).fill_null("")), strict=True):
                    ids = np.append(ids, np.uint16(end_id))
                    shard.append((doc_id, ids, 0, len(ids)))
                    held += len(ids)
                if held >= shard_tokens:
                    shard = _pack_shard(shard, out, window, query_terms, False)
                    held = sum(len(x[1]) - x[2] for x in shard)
                    yield out.flush()
        _pack_shard(shard, out, window, query_terms, True)
        if out.rows:
            yield out.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
