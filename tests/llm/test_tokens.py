import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from larkspur.llm import bpe, id_coder, token_files

TEXTS = ["", "Hello, world! It's 2024's finest.", "  two  spaces\n\nnew\tline ", "naïve façade 日本語 🎉🎉 العربية", "x" * 5000, "\x1c\x85  a", "ain't we'll I'd 'S"]


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.tokenizer(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(tokenizer):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})


def test_perfect_hash_is_minimal(tokenizer):
    table = tokenizer.whole
    assert None not in table.keys and len(table.keys) == len(tokenizer.ranks)
    assert all(table.get(k) == v for k, v in tokenizer.ranks.items())
    assert table.get(b"not an entry of it") == -1 and bpe.PerfectHash({}).get(b"x") == -1


def test_ids_equal_the_library(tokenizer, reference):
    rng = random.Random(3)
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x4F00), 32, 10])) for _ in range(80)) for _ in range(200)]
    for t in TEXTS + mixed:
        ids = tokenizer.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t) and tokenizer.decode(ids) == t.encode()


def test_round_trip_rows(make, awkward, reference):
    docs, path = make(awkward), public_tokenizers.path(bpe.VOCABULARY)
    for r in bpe.round_trip(docs, path).collect():
        text = awkward[r.doc_id] if not isinstance(awkward[r.doc_id], tuple) else awkward[r.doc_id][0]
        ids = reference.encode_ordinary(text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), path).count() == bpe.encoded(docs.limit(0), path).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 49408, n).astype(np.uint32) for n in (1, 2, 3, 700)]
    blocks += [np.zeros(900, np.uint32), np.tile(np.arange(7, dtype=np.uint32), 100), np.array([65535, 0, 65535], np.uint32), np.minimum(rng.geometric(0.05, 8192), 400).astype(np.uint32)]
    coded = id_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_coder.decode_blocks(coded), strict=True))
    assert id_coder.encode_blocks([]) == [] and id_coder.decode_blocks([]) == []
    assert len(coded[4]) < 60 and len(coded[5]) < 120  # repetition is nearly free
    for k in (0, 3, 7):
        assert np.array_equal(id_coder.decode_blocks([coded[k]])[0], blocks[k])  # a block stands alone
    broken = bytearray(coded[3])
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        id_coder.decode_blocks([bytes(broken)])


def test_segment_head_is_checked():
    data = bytearray(token_files.pack_segment([1, None], [np.array([5, 1], np.uint32), np.array([1], np.uint32)]))
    assert token_files.unpack_segment(bytes(data))[0] == [1, None]
    data[10] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack_segment(bytes(data))


def test_documents_of_segments(make, awkward):
    path = public_tokenizers.path(token_files.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = [a[0] if isinstance(a, tuple) else a for a in awkward] + TEXTS
    segments = token_files.token_segments(make(texts), path, segment_ids=50).cache()
    at = 0
    for r in token_files.documents_of(segments).orderBy("doc_id").collect():
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.documents_of(token_files.token_segments(make(texts).limit(0), path)).count() == 0


def test_new_words_go_to_the_library_together():
    words = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    library, handed = words.library, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **options)

    words.library = Counted()
    rng = random.Random(8)
    texts = [" ".join("".join(chr(rng.choice([rng.randrange(33, 127), rng.randrange(0x300, 0x340), rng.randrange(0x3B0, 0x4FF)])) for _ in range(rng.randint(0, 9))) for _ in range(300)) for _ in range(20)]
    texts += ["", "  ", "\x01", "a \x01 b\x01c \x01\x01", "e \u0301x \u0301 \u0327", "don't 's 't x's\n'll", "\x0b\u2028 \xa0z", "Σ ΑΣ ΑΣ. \u1112\u1161 \u11ab"]
    expected = [np.array(got.ids, "<u4").tobytes() for got in library.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == expected and words.encode(texts) == expected
    assert len(handed) < 200  # about 6,000 words


def test_blocks_do_not_depend_on_others_in_lockstep():
    rng = np.random.default_rng(2)
    blocks = [np.minimum(rng.geometric(p, n), 60000).astype(np.uint32) for p, n in ((0.01, 8192), (0.3, 513), (0.001, 4000), (0.5, 16), (0.2, 17), (0.2, 256), (0.2, 257))]
    blocks += [rng.permutation(65536)[:8192].astype(np.uint32), np.tile(blocks[0][:90], 91)[:8190]]
    coded = id_coder.encode_blocks(blocks)
    assert [id_coder.encode_blocks([b])[0] for b in blocks] == coded
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_coder.decode_blocks(coded), strict=True))
    assert all(np.array_equal(id_coder.decode_blocks([c])[0], b) for c, b in zip(coded, blocks, strict=True))
    for k in range(16, len(coded[0]), 997):  # damage ends in an error, wherever it is
        broken = bytearray(coded[0])
        broken[k] ^= 255
        with pytest.raises(ValueError):
            id_coder.decode_blocks([bytes(broken)])


def test_pieces_of_words_are_encoded_as_whole_texts_are():
    words = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    rng = random.Random(5)
    letters = [*"abcxyzABCXYZ", *(chr(k) for k in range(0xC0, 0x100))]
    signs = [chr(k) for k in range(33, 127) if not chr(k).isalnum()]
    made = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + "".join(rng.choices(signs, k=rng.randint(0, 3))) for _ in range(6000)]
    made += [f"{w}{m}" for w in ("I", "İ", "ǅ", "K", "ſ", "ª", "µ", "e") for m in ("̇", "́", "'S", "''", "1", ".", ".́")]
    made += ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "A<|", "end|>", "'s", "X's.", "×÷", "×a"]
    texts = [sep.join(rng.sample(made, 40)) for sep in (" ", "\n\n", "\x0b", "\x0c \t", "\r", "\x1c", "\x85", "  ", "\x00 ")] + made
    expected = [np.array(got.ids, "<u4").tobytes() for got in words.library.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == expected
    handed, library = [], words.library

    class Counted:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return library.encode_batch_fast(texts, **options)

    words.library = Counted()
    assert words.encode(["Thé eñ. " + " ".join("abcé"[k % 4] * (k + 20) for k in range(500))])[0] and not handed  # letters need no normal form


def test_slices_hold_all_texts_by_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 10)
    texts = ["", None, "éé", "abcdefg", "x" * 30, "a", None, "b" * 10, "c" * 10, ""]
    found = list(token_files._slices(pa.array(texts, pa.string())))
    assert [k for a, b in found for k in range(a, b)] == list(range(len(texts)))
    assert all(b == a + 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= 10 for a, b in found) and len(found) < 8
    assert list(token_files._slices(pa.array([], pa.string()))) == []


def test_guesses_are_places_of_the_table():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 3000, 1000).astype(np.uint32)
    once, thrice = id_coder.encode_blocks([passage, np.tile(passage, 3)])
    assert len(thrice) < 1.5 * len(once)  # 2,000 of 3,000 ids are foretold
    alphabet = np.array([0, 254, 255, 509, 765, 1020, 30000, 65535], np.uint32)
    assert np.array_equal(id_coder._unpack_gaps(b"xx" + id_coder._pack_gaps(alphabet) + b"\xff\xff", 2, len(alphabet))[0], alphabet)
    assert np.array_equal(id_coder.decode_blocks([once, thrice])[1], np.tile(passage, 3))


def test_blocks_that_end_early_leave_others_alone():
    rng = np.random.default_rng(6)
    blocks = [np.minimum(rng.zipf(1.3, n), 50000).astype(np.uint32) for n in rng.integers(1, 8192, 40)]
    coded = id_coder.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_coder.decode_blocks(coded), strict=True))
    assert [id_coder.encode_blocks([b])[0] for b in blocks[:5]] == coded[:5]


def test_tables_hold_no_more_than_each_blocks_places():
    sizes = np.array([3, 8000, *[5] * 100], np.int64)
    tables = id_coder._Tables(sizes)
    tables.refresh(0, np.empty((0, len(sizes)), np.int64))
    places = sizes + id_coder.GUESSES
    assert len(tables.below) == len(tables.weight) == places.sum()  # not as many for each as the widest has
    for bits, weights in zip(tables.bits, np.split(tables.weight, np.cumsum(places)[:-1]), strict=True):
        assert weights.min() > 0 and weights.sum() == 1 << bits


def test_places_are_those_of_a_plain_memory():
    rng = np.random.default_rng(7)
    blocks = [np.minimum(rng.zipf(1.5, n), 40000).astype(kind) for n, kind in ((1, np.uint16), (2, np.uint32), (3000, np.uint16), (8192, np.uint32))]
    blocks += [np.tile(rng.permutation(65536)[:50].astype(np.uint16), 9), np.full(700, 65535, np.uint16), np.arange(8192, dtype=np.uint16)]
    for ids in blocks:
        alphabet, places = id_coder._alphabet_and_places(ids)
        assert alphabet.tolist() == sorted(set(ids.tolist()))
        number, one, two, last, before, expected = {x: k for k, x in enumerate(alphabet.tolist())}, {}, {}, 0, 0, []
        for x in ids.tolist():
            slot = (last * 1213 - before * 1212) % id_coder.TABLE
            expected.append(1 if two.get(slot) == x else 0 if one.get(last) == x else number[x] + id_coder.GUESSES)
            one[last] = two[slot] = x
            last, before = number[x] + 1, last
        assert places.tolist() == expected


def test_words_that_come_again_stay_known(monkeypatch):
    words = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    monkeypatch.setattr(token_files, "MEMO", 400)
    handed, model = [], words.model

    class Counted:
        def encode_batch_fast(self, texts, **options):
            handed.extend(w for text in texts for w in text.split(" "))
            return model.encode_batch_fast(texts, **options)

    words.model = Counted()
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    for k in range(30):
        text = " ".join(["same", *(name(1000 + 100 * k + j) for j in range(100)), "words;"])
        assert words.encode([text]) == [np.array(words.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert handed.count("same") == handed.count("words") == 1 and len(handed) == 3002
    assert len(words.memo) + len(words.older) < 800
