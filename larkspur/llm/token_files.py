"""Token ids of a corpus in compressed segments, written in document order and read back.

A segment holds consecutive documents: a magic, the numbers of documents and blocks, their ids and
lengths, the lengths of its blocks, a crc32 of all that, then the blocks of module id_coder, each of
which starts afresh and ends in its own checksum. A segment or block can be read without the others.
Segments lie in a Parquet table (first_doc, seq, n_ids, segment), so any file system that Spark
knows can hold them and a task that is lost is written again.

Texts are range-sorted by id, so a task writes consecutive documents. White space never joins two
tokens of this vocabulary, so words between ASCII blanks are listed once a slice of texts. Nor do
LETTERS and SIGNS behind them join, and case is dropped: a word of both is two pieces, its letters in
lower case and its signs; any other word is one piece. Pieces are encoded by the tokenizers library and
remembered in two halves: where the newer one exceeds half of MEMO before a slice, it becomes the older one, and
what it replaces is forgotten; a piece that comes again counts as new. The library gets TOGETHER new pieces a text.
Letters have their normal form and are split by blanks alone, so they go to the same model without these
steps, and a piece ends where a token ends a word; the others have a mark between them.

Edge cases: a null text is empty and holds the end id alone; null ids come first, equal ids in order
of text; a document longer than SEGMENT_IDS makes a longer segment; an empty table gives no segment;
other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm.id_coder import BLOCK, decode_blocks, encode_blocks
from larkspur.storage import materialize, table

MAGIC = b"LKTOKENS"
SEGMENT_IDS = 1 << 23
MEMO = 3 << 18
TOGETHER = 64
SLICE = 3 << 23  # bytes of texts encoded at a time, or one text
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SIGNS = r"!-&(-/:-@\[-`{-~"  # those of ASCII but the apostrophe
MARK = "\x01"
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_HEAD = struct.Struct("<8sII")
NULL_ID = -(1 << 63)


class WordEncoder:
    """Ids of texts: the library's, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for words cost more than they save
        self.library = Tokenizer.from_file(path)
        in_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare = json.loads(self.library.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, in_bytes]}}
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.last = np.zeros(1 << 16, np.bool_)  # the tokens that end a word
        self.last[[k for token, k in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.mark = self._library([MARK])[0]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, "<u2") for got in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        odd = [w for w in words if MARK in w or len(self.mark) != 1]  # by themselves
        found = {word: ids.tobytes() for word, ids in zip(odd, self._library(odd), strict=True)}
        even = [w for w in words if w not in found] if odd else words
        ids = self._library([f" {MARK} ".join([*even[k : k + TOGETHER], ""]) for k in range(0, len(even), TOGETHER)])
        ids = np.concatenate([*ids, self.mark[:0]])
        ends = np.flatnonzero(ids == self.mark[0])
        found.update(zip(even, self._cut(ids, np.append(0, ends[:-1] + 1), ends), strict=True))
        return [found[w] for w in words]

    def _learn_letters(self, words: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast([" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(got.ids, "<u2") for got in found])
        ends = np.flatnonzero(self.last[ids]) + 1
        return self._cut(ids, np.append(0, ends[:-1]), ends)

    def _cut(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        data = ids.tobytes()
        return [data[at:end] for at, end in zip((2 * starts[: len(ends)]).tolist(), (2 * ends).tolist(), strict=True)]

    def _ids_of(self, pieces: pa.DictionaryArray, learn) -> pa.LargeBinaryArray:
        """Ids of each piece as bytes; no bytes for null."""
        if len(self.memo) > MEMO // 2:
            self.memo, self.older = {}, self.memo
        texts = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = [*map(self.memo.get, texts), b""]
        missing = [k for k, ids in enumerate(held) if ids is None]
        again = [texts[k] for k in missing]
        known = list(map(self.older.get, again))
        unknown = [piece for piece, ids in zip(again, known, strict=True) if ids is None]
        learned = itertools.chain.from_iterable(learn(unknown[at : at + 4096]) for at in range(0, len(unknown), 4096))
        known = [next(learned) if ids is None else ids for ids in known]
        self.memo.update(zip(again, known, strict=True))
        for k, ids in zip(missing, known, strict=True):
            held[k] = ids
        return pa.array(held, pa.large_binary()).take(pc.fill_null(pieces.indices, len(texts)))

    def _pieces(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Ids of each word as bytes."""
        cut = pc.extract_regex(words, f"^(?P<letters>[{LETTERS}]+)(?P<signs>[{SIGNS}]*)$")
        letters = pc.utf8_lower(pc.struct_field(cut, "letters")).dictionary_encode()
        others = pc.if_else(pc.is_valid(cut), pc.struct_field(cut, "signs"), words).dictionary_encode()
        return pc.binary_join_element_wise(self._ids_of(letters, self._learn_letters), self._ids_of(others, self._learn), pa.scalar(b"", pa.large_binary()))

    def encode_slice(self, texts: pa.Array, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each followed by `tail`; how many each has with it)."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        pool = pa.concat_arrays([self._pieces(words.dictionary), pa.array([tail.astype("<u2").tobytes()], pa.large_binary())])
        ends = np.cumsum(pc.list_value_length(split).to_numpy().astype(np.int64) + 1)
        codes = np.full(int(ends[-1]) if len(ends) else 0, len(pool) - 1, np.int32)
        inner = np.ones(len(codes), np.bool_)
        inner[ends - 1] = False
        codes[inner] = words.indices.to_numpy()
        found = pool.take(pa.array(codes))
        offsets = np.frombuffer(found.buffers()[1], np.int64, len(codes) + 1, 8 * found.offset) // 2
        ids = np.frombuffer(found.buffers()[2] or b"", "<u2")[offsets[0] : offsets[-1]]
        return ids, np.diff(offsets[ends], prepend=offsets[0])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        ids, sizes = self.encode_slice(pa.array(texts, pa.string()), np.empty(0, "<u2"))
        return [part.tobytes() for part in np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])] if texts else []


def _slices(texts: pa.Array):
    """(first, end) of consecutive texts that hold up to SLICE bytes, or one text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, SLICE + (ends[at - 1] if at else 0), side="right")))
        yield at, end
        at = end


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and file."""
    return WordEncoder(path)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = encode_blocks([flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)])
    head = _HEAD.pack(MAGIC, len(doc_ids), len(blocks))
    head += np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    head += np.array([len(x) for x in ids], "<u4").tobytes() + np.array([len(b) for b in blocks], "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def unpack_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """(ids of documents, their token ids); raises ValueError where a checksum fails."""
    magic, n_docs, n_blocks = _HEAD.unpack_from(data)
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
    sizes = np.frombuffer(data, "<u4", n_blocks, at + 12 * n_docs).tolist()
    at += 12 * n_docs + 4 * n_blocks
    if magic != MAGIC or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("head of a segment of token ids")
    at += 4
    blocks = []
    for size in sizes:
        blocks.append(data[at : at + size])
        at += size
    flat = np.concatenate(decode_blocks(blocks)) if blocks else np.empty(0, np.uint32)
    return [None if d == NULL_ID else d for d in doc_ids.tolist()], np.split(flat, np.cumsum(lengths)[:-1]) if n_docs else []


def _segments(path: str, end_id: int, segment_ids: int):
    end_ids = np.array([end_id], "<u2")

    def run(batches):
        words, seq, docs, ids, held = encoder(path), 0, [], [], 0

        def flush():
            nonlocal seq, docs, ids, held
            out = pa.RecordBatch.from_arrays([pa.array([docs[0]], pa.int64()), pa.array([seq], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_segment(docs, ids)], pa.binary())], ["first_doc", "seq", "n_ids", "segment"])
            seq, docs, ids, held = seq + 1, [], [], 0
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, end in _slices(texts):
                flat, sizes = words.encode_slice(pc.fill_null(texts.slice(at, end - at), ""), end_ids)
                for doc, part in zip(names[at:end], np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    docs.append(doc)
                    ids.append(part)
                    held += len(part)
                    if held >= segment_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def token_segments(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text", end_id=END_ID, segment_ids=SEGMENT_IDS) -> DataFrame:
    """(first_doc, seq, n_ids, segment): the corpus in ascending order of id."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_segments(path, end_id, segment_ids), "first_doc long, seq long, n_ids long, segment binary")


def _read(batches):
    for batch in batches:
        for first, seq, segment in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            docs, ids = unpack_segment(segment)
            sizes = np.array([len(x) for x in ids], np.int64)
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([first] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                ["first_doc", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def documents_of(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: read from the segments."""
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select("first_doc", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset")).toDF("f", "s", "offset")
    rows = segments.select("first_doc", "seq", "segment").mapInArrow(_read, "first_doc long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = rows.join(offsets, rows["first_doc"].eqNullSafe(offsets["f"]) & (rows["seq"] == offsets["s"]))
    return joined.select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir):
    segments = materialize(token_segments(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)), "tokens")
    return documents_of(segments)
