"""Conversation structure repair by a min-plus scan over turns, in parallel within a conversation.

Role initials must read `(s?(ua)+)?`: an automaton of four states (start, after s, after u, after a). A turn
is a 4 x 4 matrix over pairs (cost, audit): the least pair that leads from one state through any inserts and
the turn's own edit to another. Pairs add costs and join audits; the least pair has the least cost, then the
ASCII-least audit. That order survives joining on both sides, since audits of equal cost over the same turns
never begin one another (an audit ends with its last turn's edit, and what an edit does follows from the
state), so matrices multiply associatively.

Rows are range-partitioned by conversation and turn and written once; a chunk is CHUNK rows in a row. Each chunk
multiplies the matrices of the conversations in it. A conversation inside one chunk ends there. Of the
others each chunk is one matrix, whose audits are named by a letter (rank among the audits of its first
state, and last state), and a tree of FAN matrices a node reduces them; the letters on the cheapest way
then choose each chunk's audit. So no task holds a conversation, however long; only the audit itself,
a letter a turn, is one value, and a digest of the repaired text is a chain by nature: its task streams
a conversation in order and holds one batch.

A duplicate is a row whose (role, text) has its first position elsewhere: first positions are pre-aggregated and
joined by position, so a text that fills a third of the rows meets nowhere.

Edge cases: null roles and texts read as one space; null conversations are one conversation, null turns come
first; turns of equal number go by role and text; repeated rows are duplicates; a role other than s, u, a
can't be kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.importance import CRC_TABLE, crc32_sql
from larkspur.storage import materialize, table

BLANKS = " \t\n\x0b\x0c\r"
CHUNK_BITS = 10  # 1,024 rows a chunk
FAN_BITS = 6  # 64 matrices a node of the tree
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}

#: What an insert or a new role leads to from each state; what keeping an initial leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Inserts without a detour: state -> {state: audit}. The last are what completes a conversation.
INSERTS = tuple({s: "", NEXT[s]: "I"} | ({ASSISTANT: "II"} if s in (START, SYSTEM) else {}) for s in range(4))
COMPLETE = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def turn_matrix(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit): the least way through any inserts and one turn's edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = TRUNCATED * (fault == "t")
    for i, inserts in enumerate(INSERTS):
        for s, audit in inserts.items():
            edits = [(s, DELETE, "D")]
            if fault not in ("b", "d"):
                edits.append((NEXT[s], REROLE + extra, "R"))
                if s in KEPT.get(initial, ()):
                    edits.append((KEPT[initial][s], KEEP + extra, "K"))
            for j, cost, letter in edits:
                way = (INSERT * len(audit) + cost, audit + letter)
                best[i, j] = min(best.get((i, j), way), way)
    return [(i, j, *way) for (i, j), way in sorted(best.items())]


MATRICES = {(r, f): turn_matrix(r, f) for r, f in product("sua-", "bdt-")}


def advance(ways: dict[int, tuple[int, str]], matrix) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) to each state, one matrix on."""
    out: dict[int, tuple[int, str]] = {}
    for i, j, cost, audit in matrix:
        if i in ways:
            way = (ways[i][0] + cost, ways[i][1] + audit)
            if j not in out or way < out[j]:
                out[j] = way
    return out


def completed(ways: dict[int, tuple[int, str]]) -> tuple[int, str, int]:
    """(cost, audit, last state) of the least way that ends a whole conversation; the audit lacks the last inserts."""
    cost, audit, tail, j = min((c + INSERT * len(COMPLETE[j]), a, COMPLETE[j], j) for j, (c, a) in ways.items())
    return cost, audit, j


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the rows with faults that a hash of conversation and turn deals out."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    changed = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """pos, conv_id, turn, role, text and what a turn says of itself, in order of conversation and turn, written once."""
    space = F.lit(" ")
    named = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.monotonically_increasing_id().alias("n"))
    first = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = named.withColumn("head", F.substring("text", 1, 64)).repartitionByRange(*first, F.asc("head"), F.asc("n"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    placed = dealt.sortWithinPartitions(*first, F.asc("text"), F.asc("n")).select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text", fault.alias("fault"), F.sha2("text", 256).alias("digest"))
    return materialize(placed, "turns")


def _judged(turns: DataFrame) -> DataFrame:
    """pos, chunk, conv_id, initial, fault: of each row's faults the first of blank, duplicate and truncated."""
    firsts = turns.where("fault <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    again = (F.col("fault") != "b") & F.col("first").isNull()
    joined = turns.select("pos", "conv_id", F.substring("role", 1, 1).alias("initial"), "fault").join(firsts, "pos", "left")
    return joined.select("pos", F.shiftright("pos", CHUNK_BITS).alias("chunk"), "conv_id", "initial", F.when(again, "d").otherwise(F.col("fault")).alias("fault"))


_FACTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


def _multiplied(rows: pa.Table) -> pa.Table:
    """One chunk: for each conversation in it the product of its turns' matrices, or its repair if it lies inside."""
    rows = rows.sort_by("pos")
    convs, initials, faults = rows["conv_id"].to_pylist(), rows["initial"].to_pylist(), rows["fault"].to_pylist()
    starts = [k for k in range(len(convs)) if k == 0 or convs[k] != convs[k - 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(convs)], strict=True):
        inside = a > 0 and b < len(convs)
        reached = [{i: (0, "")} for i in ([START] if a > 0 else range(4))]
        for r, f in zip(initials[a:b], faults[a:b], strict=True):
            matrix = MATRICES[r if r in KEPT else "-", f]
            reached = [advance(ways, matrix) for ways in reached]
        costs, audits, letters = [None] * 16, [None] * 16, [None] * 16
        for i, ways in enumerate(reached):
            for rank, (audit, cost, j) in enumerate(sorted((w[1], w[0], j) for j, w in ways.items())):
                costs[4 * i + j], audits[4 * i + j], letters[4 * i + j] = cost, audit, chr(65 + 4 * rank + j)
        facts = [faults[a:b].count(x) for x in "bdt"] + [sum(x + y not in _LEGAL for x, y in zip(initials[a:b], initials[a + 1 : b], strict=False))]
        matrix, repair = ((None, None, None), completed(reached[0])) if inside else ((costs, audits, letters), (None, None, None))
        out.append((a, inside, *facts, initials[a], initials[b - 1], *matrix, *repair))
    columns = list(zip(*out, strict=True))
    kinds = [pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int32()]
    firsts = rows.select(["chunk", "pos", "conv_id"]).take(pa.array(columns[0], pa.int64()))
    names = ["inside", *_FACTS, "first", "last", "costs", "audits", "letters", "cost", "audit", "final"]
    return pa.table([*firsts.columns, *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], names=["chunk", "pos", "conv_id", *names])


def _reduced(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Up to FAN matrices of a conversation in order, multiplied; letters are joined as audits are."""
    rows = rows.sort_by("seq")
    reached = [{i: (0, "")} for i in range(4)]
    for costs, letters in zip(rows["costs"].to_pylist(), rows["letters"].to_pylist(), strict=True):
        matrix = [(k // 4, k % 4, costs[k], letters[k]) for k in range(16) if costs[k] is not None]
        reached = [advance(ways, matrix) for ways in reached]
    flat = [reached[k // 4].get(k % 4, (None, None)) for k in range(16)]
    head = rows.select(["conv_id"]).slice(0, 1)
    return pa.table([*head.columns, pa.array([key[1].as_py()], pa.int64()), pa.array([[c for c, _ in flat]], pa.list_(pa.int64())), pa.array([[x for _, x in flat]], pa.list_(pa.string()))], names=["conv_id", "seq", "costs", "letters"])


def _ended(batches):
    """The least way through a whole conversation's matrix, from the start."""
    for batch in batches:
        out = []
        for costs, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out.append(completed({j: (costs[j], letters[j]) for j in range(4) if costs[j] is not None}))
        columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", "cost", "way", "final"])


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, edits, facts) for rows (conv_id, turn, role, text), each written once.

    turns: the rows in order, by pos. edits: chunk, pos, conv_id, entry, audit, one row for each conversation of each chunk: from
    state `entry` at row pos on, audit edits the chunk's rows. facts: a row for each conversation with counts and cost.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = _ordered(rows)
    blocks = _judged(turns).groupBy("chunk").applyInArrow(
        _multiplied,
        f"chunk long, pos long, conv_id {kind}, inside boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>, letters array<string>, cost long, audit string, final int",
    )
    blocks = materialize(blocks, "blocks")
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")  # one row a chunk
    joint = F.lag("last").over(by_chunk)
    outer = blocks.where("NOT inside").select("*", (F.row_number().over(by_chunk) - 1).cast("long").alias("seq"), F.concat(joint, "first").alias("joint"))
    outer = materialize(outer.drop("cost", "audit", "final"), "outer")

    node = materialize(outer.select("conv_id", "seq", "costs", "letters"), "tree")
    while (node.agg(F.max("seq")).first()[0] or 0) > 0:  # a level of the tree
        grouped = node.withColumn("parent", F.shiftright("seq", FAN_BITS)).groupBy("conv_id", "parent")
        node = materialize(grouped.applyInArrow(_reduced, f"conv_id {kind}, seq long, costs array<long>, letters array<string>"), "tree")
    ways = materialize(node.select("conv_id", "costs", "letters").mapInArrow(_ended, f"conv_id {kind}, cost long, way string, final int"), "ways")

    letters = F.split("way", "")
    steps = ways.select("conv_id", F.posexplode(F.transform(letters, lambda x, k: F.struct(F.when(k == 0, START).otherwise((F.ascii(F.get(letters, k - 1)) - 65) % 4).alias("entry"), ((F.ascii(x) - 65) % 4).alias("exit"), (k == F.size(letters) - 1).alias("ends")))).alias("seq", "step"), "final")
    chosen = outer.alias("o").join(steps.alias("s"), F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("o.seq") == F.col("s.seq")))
    complete = F.element_at(F.array(*[F.lit(COMPLETE[k]) for k in range(4)]), F.col("final") + 1)
    audit = F.get("audits", F.col("step.entry") * 4 + F.col("step.exit"))
    edits = blocks.where("inside").select("chunk", "pos", "conv_id", F.lit(START).alias("entry"), F.concat("audit", complete).alias("audit"))
    edits = edits.unionByName(chosen.select("chunk", "pos", "o.conv_id", F.col("step.entry").alias("entry"), F.concat(audit, F.when(F.col("step.ends"), complete).otherwise("")).alias("audit")))

    crossing = outer.where("joint NOT IN ('su', 'ua', 'au')").select("conv_id", F.lit(1).cast("long").alias("illegal"))
    parts = blocks.select("conv_id", *_FACTS, "cost").unionByName(ways.select("conv_id", "cost"), allowMissingColumns=True).unionByName(crossing, allowMissingColumns=True)
    counts = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in (*_FACTS, "cost")])
    spans = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    facts = spans.alias("s").join(counts.alias("c"), F.col("s.conv_id").eqNullSafe(F.col("c.conv_id"))).select("s.conv_id", "gaps", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*_FACTS, "cost")])
    return turns, materialize(edits, "edits"), facts


def _edited(batches):
    """(batch, index of the row, role, text, letter) for each edit of rows (conv_id, entry, audit, role, text) in order; role is None where the row goes.

    A row with an audit starts a chunk's share of a conversation; the rows that it edits follow.
    """
    state, audit, at, tail = START, "", 0, 0
    for batch in batches:
        entries, audits, roles, texts = (batch.column(k) for k in range(1, 5))
        for k in range(len(batch)):
            if audits[k].is_valid:
                state, audit, at = entries[k].as_py(), audits[k].as_py(), 0
                tail = len(audit.rstrip("I"))
                continue
            while audit[at] == "I":
                state, at = NEXT[state], at + 1
                yield batch, k, NAMES[state], "", "I"
            letter, at = audit[at], at + 1
            if letter == "D":
                yield batch, k, None, None, "D"
            elif letter == "K":
                role = roles[k].as_py()
                state = KEPT[role[:1]][state]
                yield batch, k, role, texts[k].as_py(), "K"
            else:
                state = NEXT[state]
                yield batch, k, NAMES[state], texts[k].as_py(), "R"
            while tail <= at < len(audit):  # after the conversation's last row
                state, at = NEXT[state], at + 1
                yield batch, k, NAMES[state], "", "I"


def _lined_up(turns: DataFrame, edits: DataFrame, by: str) -> DataFrame:
    """conv_id, entry, audit, role, text, pos: each audit before the rows that it edits, dealt by `by`."""
    chunked = turns.select(F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "conv_id", "role", "text", "turn")
    both = edits.unionByName(chunked, allowMissingColumns=True)
    return both.repartition(by).sortWithinPartitions(F.asc_nulls_first(by), "pos", F.desc_nulls_last("audit")).select("conv_id", "entry", "audit", "role", "text", "pos", "turn")


def _digested(batches):
    """conv_id, audit, repaired_sha256 of conversations that follow each other row by row."""
    conv, audit, digest, empty = None, [], None, True
    schema = None
    for batch, k, role, text, letter in _edited(batches):
        here = batch.column(0)[k]
        schema = schema or batch.schema.field(0)
        if digest is None or here != conv:
            if digest is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], schema.type), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])
            conv, audit, digest, empty = here, [], hashlib.sha256(), True
        audit.append(letter)
        if role is not None:
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], schema.type), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])


def digests(turns: DataFrame, edits: DataFrame) -> DataFrame:
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _lined_up(turns, edits, "conv_id").mapInArrow(_digested, f"conv_id {kind}, audit string, repaired_sha256 string")


def _listed(batches):
    """The repaired rows, a batch of rows for each batch read or so."""
    out, batch = [], None
    names = ["conv_id", "pos", "place", "turn", "role", "text", "edit"]

    def flushed(of):
        at = pa.array([x[0] for x in out], pa.int64())
        rest = [pa.array([x[k] for x in out], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.string()))]
        turn = pa.array([None if x[4] == "I" else of.column(6)[x[0]].as_py() for x in out], of.schema.field(6).type)
        return pa.RecordBatch.from_arrays([of.column(0).take(at), of.column(5).take(at), rest[0], turn, *rest[1:]], names)

    place, last = 0, None
    for now, k, role, text, letter in _edited(batches):
        if now is not batch:
            if out:
                yield flushed(batch)
            out, batch = [], now
        if role is not None:
            pos = now.column(5)[k].as_py()
            place, last = (place + 1, pos) if pos == last else (0, pos)
            out.append((k, place, role, text, letter))
    if out:
        yield flushed(batch)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, pos, place, turn, role, text, edit: the repaired conversations, in order of (pos, place); inserted rows have no turn."""
    turns, edits, _ = repaired(rows)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    return _lined_up(turns, edits, "chunk").mapInArrow(_listed, f"conv_id {kinds['conv_id']}, pos long, place int, turn {kinds['turn']}, role string, text string, edit string")


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of `original`: what was wrong with `rows`, the cheapest repair, and a digest of its result."""
    turns, edits, facts = repaired(rows)
    ids = original.select("conv_id").distinct()

    def of(df: DataFrame, name: str) -> tuple[DataFrame, Column]:
        return df.alias(name), F.col("i.conv_id").eqNullSafe(F.col(f"{name}.conv_id"))

    joined = ids.alias("i").join(*of(facts, "f"), "left").join(*of(digests(turns, edits), "d"), "left")
    numbers = ("gaps", *_FACTS, "cost")
    return joined.select("i.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(rows, damaged(rows))


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, letter: str, text: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {text}}} END"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_CLOSED = f"""
  v0 AS w0, v1 AS w1,
  {_least("v2", _way("v0", "3", "I", _USER), _way("v1", "3", "I", _USER), _way("v3", "3", "I", _USER))} AS w2,
  {_least("v3", _way("v2", "3", "I", _ASSISTANT), _way("v0", "6", "II", f"{_USER} || {_ASSISTANT}"), _way("v1", "6", "II", f"{_USER} || {_ASSISTANT}"))} AS w3"""
_STAYS = "n.fault NOT IN ('b', 'd')"
_KEPT = "n.role || ':' || n.text || chr(10)"


def _kept(state: str, initial: str) -> str:
    return _way(state, "n.extra", "K", _KEPT, f"{_STAYS} AND n.role[1] = '{initial}'")


def _new(state: str, role: str) -> str:
    return _way(state, "(3 + n.extra)", "R", f"'{role}:' || n.text || chr(10)", _STAYS)


_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
ORACLE = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations),
fated AS (SELECT *, {crc32_sql("named")} % 20 AS fate FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 0 THEN 0 WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final
  FROM damaged),
turns AS (
  SELECT *, CASE WHEN final = '' THEN 'b' WHEN again THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
         CASE WHEN final = '' OR again OR final IN ('.', '!', '?') THEN 0 ELSE 3 END AS extra,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i)[1] || role[1] AS joint
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE joint NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS v0, {_NONE} AS v1, {_NONE} AS v2, {_NONE} AS v3 FROM facts
  UNION ALL
  SELECT conv_id, n.i, {_way("w0", "4", "D")}, {_least(_way("w1", "4", "D"), _kept("w0", "s"))},
         {_least(_way("w2", "4", "D"), *[f(s, r) for s in ("w0", "w1", "w3") for f, r in ((_kept, "u"), (_new, "user"))])},
         {_least(_way("w3", "4", "D"), _kept("w2", "a"), _new("w2", "assistant"))}
  FROM (SELECT conv_id AS conv, i AS at, {_CLOSED} FROM walk) p JOIN turns n ON n.conv_id IS NOT DISTINCT FROM p.conv AND n.i = p.at + 1),
ended AS (SELECT conv_id, {_least("w0", "w3")} AS best FROM (SELECT w.conv_id, {_CLOSED} FROM walk w JOIN facts f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON o.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
