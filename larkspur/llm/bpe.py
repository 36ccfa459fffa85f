"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary answers pre-tokens that are one entry as a
whole. Tier two: for the others, a heap of adjacent pairs over linked bytes applies merges in rank
order, leftmost first. Decoding concatenates the entries of the ids.

A worker builds the hash once from the rank file. Pre-tokens seen lately keep their ids in a memo of
MEMO entries, emptied when full. Each text is encoded whole, in one task, without a shuffle.

Edge cases: a null text is empty and gives no ids; lone surrogates can't occur in Parquet strings;
repeated rows give repeated results; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame

from larkspur.storage import table

MEMO = 1 << 19
LONGEST_MEMO_PIECE = 64
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class PerfectHash:
    """Minimal perfect hash by hash and displace: keys fill the slots 0..n-1 exactly.

    Buckets are placed from the largest; each stores the displacement that sends its keys to free
    slots. A bucket of one key stores its slot itself, as -1 - slot.
    """

    def __init__(self, entries: dict[bytes, int]):
        keys = list(entries)
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 2)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            buckets[h % self.n_buckets].append((h, key))
        self.displacement = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for h, key in members:
                self._put(self._slot(h, d), key, entries[key])
        holes = iter([s for s in range(n) if self.keys[s] is None])
        for b, members in enumerate(buckets):
            if len(members) == 1:
                slot = next(holes)
                self.displacement[b] = -1 - slot
                self._put(slot, members[0][1], entries[members[0][1]])

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFF)) % self.n

    def _put(self, slot: int, key: bytes, value: int) -> None:
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.displacement[h % self.n_buckets]
        slot = -1 - d if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: pairs of neighbours merge by lowest rank, leftmost first.

    The parts are linked by their start positions; a heap entry packs rank, start and end of a pair,
    and is stale if its start is gone or its second part has changed.
    """
    n = len(piece)
    rank_of = ranks.get
    ids = [ranks[piece[i : i + 1]] for i in range(n)]
    following = list(range(1, n + 1))  # start of the part after the one that starts here; 0: merged away
    following.append(0)
    before = list(range(-1, n))
    width = n.bit_length()
    mask = (1 << width) - 1
    heap = [(((r << width) | i) << width) | (i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        end = entry & mask
        i = (entry >> width) & mask
        j = following[i]
        if not j or following[j] != end:
            continue
        ids[i] = entry >> (2 * width)
        following[j] = 0
        following[i] = end
        if end < n:
            before[end] = i
            if (r := rank_of(piece[i : following[end]])) is not None:
                push(heap, (((r << width) | i) << width) | following[end])
        p = before[i]
        if p >= 0 and (r := rank_of(piece[p:end])) is not None:
            push(heap, (((r << width) | p) << width) | end)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = following[i]
    return out


class Tokenizer:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = PerfectHash(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.entries = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for entry, rank in self.ranks.items():
            self.entries[rank] = entry
        self.memo = _Memo(self)

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.whole.get(piece)
        return [rank] if rank >= 0 else merge_bytes(piece, self.ranks)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


class _Memo(dict):
    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        ids = self.tokenizer.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_MEMO_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a worker process and file."""
    return Tokenizer(path)


def encoded(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and exact (the ids decode to the text's bytes) of each row."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [tok.encode(t) for t in texts]
                sizes = [len(x) for x in ids]
                exact = [tok.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), lists, pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>, exact boolean")


def round_trip(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the bytes they decode to."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = tok.encode_bytes(text.as_py() or "")
                decoded = tok.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
