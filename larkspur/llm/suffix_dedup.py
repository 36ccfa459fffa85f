"""Exact substring dedup: every byte covered by a string of `least` bytes that starts twice in the corpus goes.

Judging is done on suffix arrays (module bwt), the corpus is only dealt out to them. Each window of
`least` bytes belongs to its leftmost smallest k-gram, its anchor: equal windows have equal anchors at
equal places, so all windows of an anchor can be judged together and apart from the others. Windows
whose anchor starts once in the corpus can't repeat and go no further. The others, as contexts (runs
of windows with one anchor, about 600 bytes), meet by anchor; equal contexts are one row with their
number. A context that occurs twice is repeated as a whole. It goes to the suffix array once, for the
others of its anchor, and only contexts that share the bytes around the anchor with another one that
is left to be judged go there at all. Each task builds arrays over BATCH bytes of contexts at a time.

An anchor whose distinct contexts exceed GROUP bytes is refined: windows are split by the anchor's
distance from their start, the near and the far half of the possible distances, and dealt by a hash of
the bytes that all windows of the half hold. At the end a half is one distance, hence one window,
whose copies are one row. So no group is collected into one task, and none is dropped.

Edge cases: null is empty; a text shorter than `least` has no window and stays whole; equal texts and
repeated rows count as often as they occur; rows are identified by id and text, so ids may repeat or
be null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bwt import repeated_starts
from larkspur.storage import discard, materialize, table

LEAST = 400
GRAM = 32
BATCH = 1 << 20
ROWS = 1 << 14  # contexts held at a time
GROUP = 4 << 20
# Passages of more than 50 words that repeat: most have fewer than 400 bytes, so that `least` alone misses them.
PASSAGE_BYTES = 256
PASSAGE_WORDS = 50
PIECE = 1 << 19  # bytes of one text anchored at a time
TOGETHER = 1 << 15  # bytes of short texts anchored at a time: their arrays stay in a core's cache

_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = np.uint64((1 << 20) - 1)


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the bytes [i, i + width) for each i, by doubling; width is a power of two."""
    h, have = _LETTERS[data], 1
    while have < width:
        h = h[:-have] * np.uint64(0xD6E8FEB86659FD93 + 2 * have) + h[have:]
        have *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, values
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(values) - width + 1], m[width - have :])


def anchored_runs(data: np.ndarray, least: int, gram: int):
    """(anchor, first window, last window, anchor's place) arrays: maximal runs of windows with one anchor."""
    anchors, firsts, lasts, places = [], [], [], []
    for at in range(0, max(0, len(data) - least + 1), PIECE):
        part = data[at : at + PIECE + least - 1]
        if len(part) < least:
            break
        hashes = _gram_hashes(part, gram)
        tagged = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        place = (_window_min(tagged, least - gram + 1) & _POSITION).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        anchors.append(hashes[place[starts]].view(np.int64))
        firsts.append(starts + at)
        lasts.append(np.append(starts[1:], len(place)) - 1 + at)
        places.append(place[starts] + at)
    if not anchors:
        return (np.empty(0, np.int64),) * 4
    return tuple(map(np.concatenate, (anchors, firsts, lasts, places)))


def _anchored_together(texts: list[bytes], least: int, gram: int):
    """anchored_runs of texts laid end to end, with the number of the text first; windows across two texts are left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < least:
        return (np.empty(0, np.int64),) * 5
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    hashes = _gram_hashes(data, gram)
    tagged = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    place = (_window_min(tagged, least - gram + 1) & _POSITION).astype(np.int64)
    within = np.repeat(ends - least, sizes)[: len(place)] >= np.arange(len(place))
    cut = np.concatenate([[True], (place[1:] != place[:-1]) | ~within[:-1] | ~within[1:], [True]])  # between a window and the one before
    firsts, lasts = np.flatnonzero(within & cut[:-1]), np.flatnonzero(within & cut[1:])
    text = np.searchsorted(ends, firsts, side="right")
    begin, places = (ends - sizes)[text], place[firsts]
    return text, hashes[places].view(np.int64), firsts - begin, lasts - begin, places - begin


def anchored_texts(texts: list[bytes], least: int, gram: int):
    """(number of the text, anchor, first window, last window, anchor's place) arrays: anchored_runs of each text, in order."""
    parts, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= TOGETHER:
            size += len(texts[end])
            end += 1
        if end > at:
            found = _anchored_together(texts[at:end], least, gram)
        else:
            runs = anchored_runs(np.frombuffer(texts[at], np.uint8), least, gram)
            found, end = (np.zeros(len(runs[0]), np.int64), *runs), at + 1
        parts.append((found[0] + at, *found[1:]))
        at = end
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.empty(0, np.int64),) * 5


def _bytes(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def _listed(texts: list[bytes], least: int, gram: int) -> pa.ListArray:
    """Each text's anchors; one that starts twice in a text is listed twice."""
    text, anchors, *_ = anchored_texts(texts, least, gram)
    by = np.lexsort((anchors, text))
    text, anchors = text[by], anchors[by]
    again = np.zeros(len(text), np.bool_)
    again[1:] = (text[1:] == text[:-1]) & (anchors[1:] == anchors[:-1])
    third = again.copy()
    third[1:] &= again[:-1]
    kept = ~third
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(anchors[kept]))


def _surveyed(widths: list[tuple[int, int]]):
    names = ["doc_id", "text_key", "n_bytes", "sha256", *(f"anchors{k}" for k in range(len(widths)))]

    def run(batches):
        for batch in _slices(batches):
            texts = [_bytes(t) for t in batch.column(1)]
            keys = pa.array([_signed(xxhash.xxh3_64_intdigest(t)) for t in texts], pa.int64())
            digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(map(len, texts), pa.int64()), digests, *(_listed(texts, *w) for w in widths)], names)

    return run


def _contexts(least: int, gram: int):
    """Occurrences of contexts with a repeated anchor: one row for each distinct context of a text.

    An anchor that one text wants starts twice in the corpus, so every text of the slice wants it too.
    """

    def run(batches):
        for batch in _slices(batches):
            docs, texts, wanted = [], [], []
            for key, text, doc, copies, anchors in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3)), batch.column(4), strict=True):
                data = _bytes(text)
                if _signed(xxhash.xxh3_64_intdigest(data)) == key:  # else another text under this id
                    docs.append((doc, copies))
                    texts.append(data)
                    wanted.append(anchors.values.to_numpy())
            if not texts:
                continue
            runs = anchored_texts(texts, least, gram)
            held = np.isin(runs[1], np.concatenate(wanted))
            found: dict[tuple[int, int, int, bytes], list[int]] = {}
            for k, a, i, j, p in zip(*(x[held].tolist() for x in runs), strict=True):
                found.setdefault((k, a, p - i, texts[k][i : j + least]), []).append(i)
            rows = [(a, _signed(xxhash.xxh3_64_intdigest(c)), docs[k][0], at, docs[k][1] * len(at), p, c) for (k, a, p, c), at in found.items()]
            for at in range(0, len(rows), 4096):
                yield _rows(rows[at : at + 4096])

    return run


def _rows(rows: list) -> pa.RecordBatch:
    key, context, doc, at, n, place, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(context, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(place, pa.int64()), pa.array(data, pa.binary())], ["key", "context", "doc", "at", "n", "place", "data"])


def _runs(starts: np.ndarray, least: int) -> list[dict]:
    """Bytes covered by windows at sorted starts, as maximal [a, b) runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > least)
    return [{"a": int(a), "b": int(b) + least} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def _common(near: int, far: int, least: int) -> list[tuple[int, int, int, int]]:
    """The near and the far half of an anchor's distances from its window's start: (lo, hi, a, b).

    All windows of a half hold the bytes [place + a, place + b) around the anchor's place.
    """
    middle = (near + far) // 2
    return [(lo, hi, -lo, least - hi) for lo, hi in ((near, middle), (middle + 1, far)) if lo <= hi]


def _shared(rows: list, least: int) -> list[int]:
    """Which contexts of one key go to the suffix array.

    Contexts with a window in common share the common bytes of one of its halves, so a context that
    shares neither with another can't repeat, and contexts that all occur twice are judged already.
    """
    if len(rows) < 2 or all(row[2] > 1 for row in rows):
        return []
    classes: dict[tuple[int, bytes], list[int]] = {}
    for i, (_, _, _, data, place, near, far) in enumerate(rows):
        for half, (lo, hi, a, b) in enumerate(_common(near, far, least)):
            if max(0, place - hi) <= min(len(data) - least, place - lo):
                classes.setdefault((half, data[place + a : place + b]), []).append(i)
    return sorted({i for held in classes.values() if len(held) > 1 and any(rows[i][2] == 1 for i in held) for i in held})


def _judged(least: int):
    """Runs of repeated bytes in each context; input sorted by key, so a key's rows are adjacent."""

    def judge(held: list, strings: list, owners: list):
        out = {k: [{"a": 0, "b": len(row[3])}] for k, row in enumerate(held) if row[2] > 1}  # repeated as a whole
        for k, marks in zip(owners, repeated_starts(strings, least), strict=True):
            if held[k][2] == 1:
                out[k] = _runs(marks, least)
        kept = [(held[k][0], held[k][1], runs) for k, runs in out.items() if runs]
        a, b, c = zip(*kept, strict=True) if kept else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["key", "context", "runs"])

    def run(batches):
        held, strings, owners, size, done, last, first = [], [], [], 0, 0, None, 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[0] != last:
                    owners += [first + k for k in _shared(held[first:], least)]
                    strings += [held[k][3] for k in owners[len(strings) :]]
                    size += sum(len(held[k][3]) for k in owners[done:])
                    done = len(owners)
                    if size > BATCH or len(held) > ROWS:
                        yield judge(held, strings, owners)
                        held, strings, owners, size, done = [], [], [], 0, 0
                    first, last = len(held), row[0]
                held.append(row)
        if held:
            owners += [first + k for k in _shared(held[first:], least)]
            strings += [held[k][3] for k in owners[len(strings) :]]
            yield judge(held, strings, owners)

    return run


def _halved(least: int):
    """Each context as two: windows whose anchor is near their start and those where it is far, keyed by their common bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, context, place, near, far, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for lo, hi, a, b in _common(near, far, least):
                    first, last = max(0, place - hi), min(len(data) - least, place - lo)
                    if first > last:
                        continue
                    half, common = data[first : last + least], data[place + a : place + b]
                    sub = _signed(xxhash.xxh3_64_intdigest(common + struct.pack("<3q", key, lo, hi)))
                    rows.append((key, context, sub, _signed(xxhash.xxh3_64_intdigest(half)), first, place - first, lo, hi, half))
            columns = zip(*rows, strict=True) if rows else ((),) * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 8 else pa.int64()) for k, x in enumerate(columns)], ["key", "context", "sub_key", "sub_context", "offset", "place", "near", "far", "data"])

    return run


def _placed_runs(occurrences: DataFrame, contexts: DataFrame, least: int, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, a, b): repeated runs of bytes of each text, from occurrences (key, context, doc, at) and contexts; and the tables that they rest on."""
    found, used = None, [occurrences]
    while True:
        hot = contexts.groupBy("key").agg(F.sum(F.length("data")).alias("bytes")).where(F.col("bytes") > group).select("key")
        hot = materialize(hot, "hot")
        more = bool(hot.take(1))
        calm = contexts.join(hot, "key", "left_anti") if more else contexts
        dealt = calm.select("key", "context", "n", "data", "place", "near", "far").repartition("key").sortWithinPartitions("key")
        runs = materialize(dealt.mapInArrow(_judged(least), "key long, context long, runs array<struct<a:long,b:long>>"), "runs")
        here = occurrences.join(runs, ["key", "context"]).select("doc", F.explode("at").alias("at"), "runs").select("doc", "at", F.explode("runs").alias("r"))
        here = here.select("doc", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"))
        found = here if found is None else found.unionByName(here)
        used.append(runs)
        if not more:
            discard(contexts, hot)
            return found, used
        halves = materialize(contexts.join(hot, "key", "left_semi").select("key", "context", "place", "near", "far", "data").mapInArrow(_halved(least), "key long, context long, sub_key long, sub_context long, offset long, place long, near long, far long, data binary"), "halves")
        numbers = contexts.join(hot, "key", "left_semi").select("key", "context", "n")
        before = contexts
        contexts = materialize(
            halves.join(numbers, ["key", "context"]).groupBy(F.col("sub_key").alias("key"), F.col("sub_context").alias("context")).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("place", "near", "far", "data")]), "contexts"
        )
        links = halves.select("key", "context", "sub_key", "sub_context", "offset")
        moved = occurrences.join(links, ["key", "context"]).select(F.col("sub_key").alias("key"), F.col("sub_context").alias("context"), "doc", F.transform("at", lambda x: x + F.col("offset")).alias("at"))
        occurrences = materialize(moved, "occurrences")
        used.append(occurrences)
        discard(before, halves, hot)


def _merged(runs: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches):
    for batch in batches:
        rows = []
        for key, text, doc, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data, at, kept = _bytes(text), 0, []
            if _signed(xxhash.xxh3_64_intdigest(data)) != key:
                continue
            spans = _merged([(r["a"], r["b"]) for r in runs])
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((doc, sum(b - a for a, b in spans), [{"a": a, "b": b, "words": len(data[a:b].split())} for a, b in spans], hashlib.sha256(b"".join(kept)).hexdigest()))
        d, n, s, h = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())]))), pa.array(h, pa.string())], ["doc", "n_removed", "spans", "kept_sha256"])


def repeated_substrings(docs: DataFrame, *, id_col="doc_id", text_col="text", least=LEAST, gram=None, group=GROUP, passage=None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte runs [a, b) removed, with their words), kept_sha256: one row an input row.

    passage: (bytes, words) adds n_passages, the maximal runs of more than `words` words whose strings of
    `bytes` bytes repeat; nothing more is removed for them.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    widths = [(size, gram or min(GRAM, 1 << max(0, (size // 2).bit_length() - 1))) for size in ([least, passage[0]] if passage else [least])]
    rows, nodes = _nodes(source, docs.schema[id_col].dataType.simpleString(), widths)
    names = materialize(nodes.select("doc", "sha256"), "names")
    results = names.join(_repeats(source, nodes.withColumnRenamed("anchors0", "anchors"), *widths[0], group), "doc", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint,words:bigint>>"))
    columns = [F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), spans.alias("spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256")]
    if passage:
        short = _repeats(source, nodes.withColumnRenamed("anchors1", "anchors"), *widths[1], group)
        long_runs = F.size(F.filter("spans", lambda s: s["words"] > passage[1])).cast("long")
        results = results.join(short.select("doc", long_runs.alias("_passages")), "doc", "left")
        columns.append(F.coalesce("_passages", F.lit(0).cast("long")).alias("n_passages"))
    discard(nodes)
    return rows.join(results.drop("doc"), "sha256", "left").select("doc_id", "n_bytes", *columns)


def _nodes(source: DataFrame, kind: str, widths: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, n_bytes, sha256), and one node a distinct text: its digest, the copies there are, one row to read it from, and its anchors at each width."""
    lists = [f"anchors{k}" for k in range(len(widths))]
    survey = materialize(source.mapInArrow(_surveyed(widths), f"doc_id {kind}, text_key long, n_bytes long, sha256 string, " + ", ".join(f"{x} array<long>" for x in lists)), "survey")
    nodes = materialize(
        survey.where(F.greatest(F.lit(0), *map(F.size, lists)) > 0)
        .groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), *(F.first(x).alias(x) for x in lists))
        .withColumn("doc", F.monotonically_increasing_id()),
        "nodes",
    )
    rows = materialize(survey.select("doc_id", "n_bytes", "sha256"), "rows")
    discard(survey)
    return rows, nodes


def _repeats(source: DataFrame, nodes: DataFrame, least: int, gram: int, group: int) -> DataFrame:
    """(doc, n_removed, spans, kept_sha256) of the nodes with repeats."""
    group = max(group, 2 * least)  # one window always fits, so refinement ends
    each = nodes.select("doc", "copies", F.explode("anchors").alias("anchor"))
    often = each.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor")
    wanted = each.join(often, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("wanted"))
    chosen = materialize(nodes.select("doc", "copies", "doc_id", "text_key").join(wanted, "doc"), "chosen")
    occurrences = materialize(_read(source, chosen, "doc", "copies", "wanted").mapInArrow(_contexts(least, gram), "key long, context long, doc long, at array<long>, n long, place long, data binary"), "occurrences")
    contexts = materialize(occurrences.groupBy("key", "context").agg(F.sum("n").alias("n"), F.first("place").alias("place"), F.first("data").alias("data")).withColumns({"near": F.lit(0).cast("long"), "far": F.lit(least - gram).cast("long")}), "contexts")
    places = materialize(occurrences.select("key", "context", "doc", "at"), "places")
    discard(occurrences)
    runs, used = _placed_runs(places, contexts, least, group)
    per_doc = runs.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    marked = materialize(chosen.select("doc", "doc_id", "text_key").join(per_doc, "doc"), "marked")
    discard(*used)
    cut = materialize(_read(source, marked, "doc", "runs").mapInArrow(_cut, "doc long, n_removed long, spans array<struct<a:long,b:long,words:long>>, kept_sha256 string").dropDuplicates(["doc"]), "cut")
    discard(chosen, marked)
    return cut


def _read(source: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """(text_key, text, columns of rows): each row with the texts under its doc_id, of which readers take the one with its key."""
    named = rows.withColumnRenamed("doc_id", "_id")
    return source.join(named, source["doc_id"].eqNullSafe(named["_id"])).select("text_key", "text", *columns)


def op1_suffix_dedup(spark, sf_dir):
    found = repeated_substrings(table(spark, sf_dir, "documents"), passage=(PASSAGE_BYTES, PASSAGE_WORDS))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passages")
