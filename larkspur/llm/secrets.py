"""Secret scan with corpus-wide ownership frequency.

Each text is scanned once for candidates: the base kinds (assign, access, hex) and further forms of
credentials. Candidate values are hashed and counted over the whole corpus by distinct repositories
and owners. A value that more than MAX_OWNERS owners, or several owners in more than MAX_REPOSITORIES
repositories, hold is a widely copied example; the others look live and belong to their owner.
Copies of a text at one owner count as one repository. Base spans always stay; a
further form becomes a span only if its value looks live.

Counting is two-level (distinct holders of a value, then holders a value), so an example that fills a
third of the corpus is aggregated before it is shuffled. Values with more than 1 / HOT of all candidates are
fewer than HOT; their verdicts are broadcast, and only candidates of other values are shuffled to theirs.

Edge cases: a null or empty text has no spans; a null owner or repository counts as one of its own
name; repeated rows are scanned and returned each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.storage import materialize, table

MAX_OWNERS = 2
MAX_REPOSITORIES = 20
HOT = 1000

# Kinds in the order of ties, their patterns, least length and the group that counts.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 32, 0),
)
FURTHER = (
    ("hosting", re.compile(r"gh[pousr]_[A-Za-z0-9]{20,}"), 24, 0),
    ("payment", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"), 24, 0),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 15, 0),
    ("claims", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 24, 0),
    ("login", re.compile(r"://[A-Za-z0-9._-]+:([^\s:@/]{6,})@"), 6, 1),
    ("bearer", re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,})"), 16, 1),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}"), 60, 0),
)
# A text without any of these strings has no match of the kind.
NEEDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "hosting": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "payment": ("k_live_",),
    "chat": ("xox",),
    "claims": ("eyj",),
    "login": ("://",),
    "bearer": ("bearer",),
    "pem": ("private key-----",),
}
KINDS = tuple(k for k, *_ in BASE + FURTHER)


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, index of kind, end, value) of all candidates, by start, then kind; offsets in code points."""
    low, found = text.lower(), []
    for k, (kind, pattern, least, group) in enumerate(BASE + FURTHER):
        if kind in NEEDS and not any(x in low for x in NEEDS[kind]):
            continue
        found += [(m.start(), k, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end, *_ in found)


_CANDIDATE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])


def _scanned(batches):
    for batch in batches:
        counts, digests, candidates, texts = [], [], [], []
        for text in batch.column(3):
            text = text.as_py() or ""
            found = scan(text)
            texts.append(xxhash.xxh128_hexdigest(text.encode("utf-8", "surrogatepass")))
            base = [x for x in found if x[1] < len(BASE)]
            counts.append([sum(x[1] == k for x in base) for k in range(len(BASE))])
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            candidates.append([{"start": a, "kind": k, "end": b, "value": xxhash.xxh64_intdigest(v.encode("utf-8")) - (1 << 63)} for a, k, b, v in found])
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns, pa.array(digests, pa.string()), pa.array(candidates, pa.list_(_CANDIDATE)), pa.array(texts, pa.string())], ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "candidates", "digest"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners, live) from rows (value, repo, owner) and perhaps digest, the text's hash: distinct holders of each value."""
    if "digest" in candidates.columns:
        candidates = candidates.groupBy("value", "owner", "digest").agg(F.min("repo").alias("repo"))
    holders = candidates.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = holders.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    counted = by_owner.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    return counted.withColumn("live", (F.col("n_owners") <= MAX_OWNERS) & ((F.col("n_owners") == 1) | (F.col("n_repos") <= MAX_REPOSITORIES)))


def _judged(each: DataFrame) -> DataFrame:
    """Candidates with `live`; those of hot values are not shuffled."""
    verdicts = materialize(ownership(each).select("value", "live"), "verdicts")
    sizes = each.groupBy("value").agg(F.count("*").alias("n"))
    often = sizes.where(F.col("n") * HOT > each.count()).select("value")
    hot = F.broadcast(materialize(verdicts.join(often, "value"), "hot"))  # fewer than HOT rows
    return each.join(hot, "value").unionByName(each.join(hot, "value", "left_anti").join(verdicts, "value"))


def secret_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", repo_col="doc_id", owner_col="source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied: one row an input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(_scanned, f"doc_id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<struct<start:int,kind:int,end:int,value:long>>, digest string")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")  # written once: row ids stay
    each = rows.select("row", "repo", "owner", "digest", F.explode("candidates").alias("c")).select("row", "repo", "owner", "digest", "c.*")
    judged = _judged(each)
    stays = F.col("live") | (F.col("kind") < len(BASE))
    spans = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(stays, F.struct("start", "kind", "end")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    joined = rows.join(spans, "row", "left")
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")])


def op8_secret_scan(spark, sf_dir):
    return secret_spans(table(spark, sf_dir, "documents"))
