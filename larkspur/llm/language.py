"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed against
it greedily: the longest match becomes a phrase, and the next phrase starts at the letter that broke
it. A language that explains the text needs few phrases; the fewest phrases, normalised by the
sample's log length, win. A letter that the sample lacks costs a phrase of its own.

The automaton is compiled to one table: state and letter give the next state and the phrases that end
there. A language's letters are all those of its sample, and one code stands for any other. Where they are
more than LETTERS - 1, the table holds the automaton's moves alone, sorted, and is searched. Texts are cut into runs of RUN letters, a phrase never crossing two runs, and all runs of a
batch step through the table together. Whole texts are parsed.

The sample is the labelled rows of smallest hash, at most SAMPLE_DOCS a language, each of at most
SAMPLE_CHARS letters; longer rows come after all shorter ones and give a piece of that length from their
first letter on. Its size doesn't depend on the input's.

Edge cases: a null text or one without a letter is `und` with score 0; a null language is not learned;
without any labelled row all texts are `und`; equal phrase counts fall to the first language by name;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.storage import table

SAMPLE_DOCS = 24
SAMPLE_CHARS = 4000
LETTERS = 64
RUN = 256
BATCH_CHARS = 1 << 21
UNDECIDED = "und"


def normal(text: str) -> np.ndarray:
    """Lower-case letters as code points, everything else a single blank between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return codes


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For each code point, 1 if it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


class _Sparse:
    """The moves of an automaton of many letters."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        self.width = width
        keys = np.array([state * width + c for state, row in enumerate(moves) for c in row], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], -1)
        self.to = np.append(np.array([to for row in moves for to in row.values()], np.int32)[order], 0)
        self.fresh = np.full(width, 2, np.int32)  # as in Parser._compile
        for c, to in moves[0].items():
            self.fresh[c] = to * 4 + 1

    def step(self, state: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """next state * 4 + phrases ended."""
        keys = state.astype(np.int64) * self.width + letters
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.to[at] * 4, np.where(state == 0, 1, self.fresh[letters]))


class Parser:
    """Suffix automata of the samples, compiled to tables."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: np.concatenate([np.append(self._letters(t), 32) for t in samples[k]] or [np.zeros(0, np.uint32)]) for k in self.languages}
        seen = np.unique(np.concatenate(list(texts.values()) or [np.zeros(0, np.uint32)]))
        self.code = np.full(0x110000, len(seen), np.int32)  # the last letter: in no sample
        self.code[seen] = np.arange(len(seen), dtype=np.int32)
        self.local, self.tables = [], []
        for k in self.languages:
            own = np.unique(self.code[texts[k]])
            local = np.full(len(seen) + 1, len(own), np.int32)  # the last letter: not in this language's sample
            local[own] = np.arange(len(own), dtype=np.int32)
            moves = self._automaton(local[self.code[texts[k]]])
            self.local.append(local)
            self.tables.append(self._compile(moves) if len(own) < LETTERS else _Sparse(moves, len(own) + 1))
        self.weights = np.array([np.log2(max(2, len(texts[k]))) for k in self.languages])

    @staticmethod
    def _letters(text: str) -> np.ndarray:
        codes = normal(text)
        codes = np.where(_is_letter()[codes], codes, np.uint32(32))
        blank = codes == 32
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        return codes[keep]

    @staticmethod
    def _automaton(letters: np.ndarray) -> list[dict[int, int]]:
        """Each state's moves by letter."""
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in letters.tolist():
            now = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = now
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        return moves

    @staticmethod
    def _compile(moves: list[dict[int, int]]) -> np.ndarray:
        """table[state * LETTERS + letter] = next state * LETTERS * 4 + phrases ended."""
        fresh = np.full(LETTERS, 2, np.int32)  # an unknown letter ends the phrase before it and is one itself
        for c, to in moves[0].items():
            fresh[c] = to * LETTERS * 4 + 1
        out = np.tile(fresh, (len(moves), 1))
        out[0] = np.where(fresh == 2, 1, fresh - 1)  # nothing was open at the root
        for state, row in enumerate(moves):
            for c, to in row.items():
                out[state, c] = to * LETTERS * 4
        return out.ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts of whole texts, and letters parsed a text."""
        letters = [self.code[self._letters(t)] for t in texts]
        sizes = np.array([len(x) for x in letters], np.int64)
        runs = -(-sizes // RUN)
        owner = np.repeat(np.arange(len(texts)), runs)
        grid = np.full((int(runs.sum()), RUN), -1, np.int32)
        at = 0
        for x, n in zip(letters, runs.tolist(), strict=True):
            grid[at : at + n].reshape(-1)[: len(x)] = x
            at += n
        ends = (grid != -1).sum(axis=1)
        order = np.argsort(-ends, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.ones(len(owner), np.bool_)
        first[1:] = owner[1:] != owner[:-1]
        before = np.where(first, -1, place[np.arange(len(owner)) - 1])[order]  # the run before, in the order of lanes
        final = np.append(first[1:], True)[order]
        steps, ends = np.ascontiguousarray(grid[order].T), ends[order]
        counts = np.zeros((len(texts), len(self.languages)))
        for k, moves in enumerate(self.tables):
            total, state = _parsed(moves, self.local[k][steps], ends, before)
            total = total + (final & (state > 0))  # the phrase that the text's end closes
            counts[:, k] = np.bincount(owner[order], weights=total, minlength=len(texts))
        return counts, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): score is how far the best language's entropy lies below the second's."""
        usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out = [(UNDECIDED, 0.0)] * len(texts)
        if not usable or not self.languages:
            return out
        counts, sizes = self.phrases([texts[i] for i in usable])
        entropy = counts * self.weights / np.maximum(1, sizes)[:, None]
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(usable)), best]
        entropy[np.arange(len(usable)), best] = np.inf
        second = entropy.min(axis=1)
        score = np.where(np.isfinite(second), 1 - lowest / np.maximum(second, 1e-12), 1.0)
        for i, b, s in zip(usable, best.tolist(), score.tolist(), strict=True):
            out[i] = (self.languages[b], min(1.0, max(0.0, s)))
        return out


def _parsed(moves, letters: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases ended in each run, state at its end), as if each text were parsed letter by letter from its first.

    letters: (RUN x runs), runs by falling length; before: each run's predecessor in its text or -1. All
    runs are parsed from the root at once; then runs whose predecessor ends elsewhere are parsed again
    from there, until they meet the state that they had at the same letter.
    """
    step_on = (lambda state, c: moves[state + c]) if isinstance(moves, np.ndarray) else moves.step
    active = np.searchsorted(-ends, -np.arange(RUN), side="left")  # runs longer than each step
    lanes = np.arange(len(ends))
    states, sums = np.zeros((RUN + 1, len(ends)), np.int32), np.zeros((RUN + 1, len(ends)), np.int32)
    for step in range(RUN):
        n = active[step]
        if not n:
            break
        got = step_on(states[step, :n], letters[step, :n])
        states[step + 1, :n] = got >> 2
        sums[step + 1, :n] = sums[step, :n] + (got & 3)
    start = np.zeros(len(ends), np.int32)
    last = states[ends, lanes]
    while True:
        wanted = np.where(before >= 0, last[before], 0)
        who = np.flatnonzero(wanted != start)
        if not len(who):
            return sums[ends, lanes], last
        start[who] = wanted[who]
        state, count = wanted[who], np.zeros(len(who), np.int32)
        for step in range(RUN):
            live = step < ends[who]
            who, state, count = who[live], state[live], count[live]
            if not len(who):
                break
            got = step_on(state, letters[step, who])
            state, count = got >> 2, count + (got & 3)
            met = states[step + 1, who] == state
            if met.any():
                k = who[met]
                sums[step + 1 :, k] += (count[met] - sums[step + 1, k])[None, :]
            apart = ~met
            who, state, count = who[apart], state[apart], count[apart]
            states[step + 1, who], sums[step + 1, who] = state, count
        last = states[ends, lanes]


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple) -> Parser:
    """One parser a worker process and sample."""
    return Parser({k: list(v) for k, v in samples})


def learn(labelled: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang") -> tuple:
    """The bounded sample: at most SAMPLE_DOCS texts a language, chosen by hash of text."""
    fit = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    long = F.length(text_col) > SAMPLE_CHARS
    piece = F.when(long, F.regexp_extract(text_col, rf"(?s)\p{{L}}.{{0,{SAMPLE_CHARS - 1}}}", 0)).otherwise(F.col(text_col))
    rows = fit.select(F.col(lang_col).alias("lang"), piece.alias("text"), F.sha2(F.col(text_col), 256).alias("key"), long.alias("long"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "key"))
    least = rows.groupBy("lang", "key").agg(F.first("long").alias("long")).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS)  # hashes first, then their texts
    chosen = rows.join(F.broadcast(least.select("lang", "key", "rank")), ["lang", "key"]).groupBy("lang", "rank").agg(F.first("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "rank").collect():  # bounded: SAMPLE_DOCS * SAMPLE_CHARS a language
        samples.setdefault(row.lang, []).append(row.text)
    return tuple((k, tuple(v)) for k, v in sorted(samples.items()))


def slices(sizes: list[int], most: int, rows: int = 1024) -> list[tuple[int, int]]:
    """(begin, end) of runs of at most `rows` texts and `most` characters together; a longer text is alone."""
    out, begin, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > most or i - begin == rows):
            out.append((begin, i))
            begin, total = i, 0
        total += size
    return [*out, (begin, len(sizes))] if sizes else out


def identify(docs: DataFrame, samples: tuple, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score of each row."""

    def run(batches):
        parser = _parser(samples)
        for batch in batches:
            for at, end in slices(pc.utf8_length(batch.column(1)).fill_null(0).to_pylist(), BATCH_CHARS):
                part = batch.slice(at, end - at)
                found = parser.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col="doc_id"):
    """Rows never learned from: remainder 2 of the id's crc32 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs.where(~held_out()))
    return identify(docs, samples).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
