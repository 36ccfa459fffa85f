"""State derived from events and records: visibility, contracts, coverage, ledgers, journals, merges and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(rows: DataFrame, *, owner: str, public: Column, viewer) -> DataFrame:
    """Rows that are public or the viewer's, with access own or public."""
    mine = F.col(owner) == viewer
    return rows.where(public | mine).withColumn("access", F.when(mine, "own").otherwise("public"))


def contract_violations(rows: DataFrame, *, least: int, most: int, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(id, violations) of answers (id, place, values) that break the contract.

    count: between least and most rows an answer; places: 1..n without gaps or repeats; a value's name:
    null, not finite or out of its range.
    """
    fine = {c: F.bool_and(F.coalesce(~F.isnan(c) & F.col(c).between(lo, hi), F.lit(False))).alias(c) for c, (lo, hi) in ranges.items()}
    seen = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.max("place").alias("last"), *fine.values())
    flags = [F.when(~F.col("n").between(least, most), "count"), F.when((F.col("places") != F.col("n")) | (F.col("last") != F.col("n")), "places"), *[F.when(~F.col(c), c) for c in ranges]]
    return seen.select("id", F.filter(F.array(*flags), lambda f: f.isNotNull()).alias("violations")).where(F.size("violations") > 0)


def roles(items: DataFrame, decided: DataFrame, *, key: str, text: str, rules: list[tuple[str, str]], other: str) -> DataFrame:
    """(key, role): the decision if there is one, else the first rule (pattern, role) that the text matches."""
    rule = F.lit(None).cast("string")
    for pattern, role in reversed(rules):
        rule = F.when(F.col(text).rlike(pattern), role).otherwise(rule)
    return items.join(decided, key, "left").select(key, F.coalesce("decided", rule, F.lit(other)).alias("role"))


def coverage(catalogue: DataFrame, rows: DataFrame, *, key: str, counts: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """Every catalogue key with the number of its rows, conditional counts and sums, zero where it has none."""
    grouped = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in sums.items()])
    return catalogue.join(grouped, key, "left").na.fill(0)


def collection_counters(rows: DataFrame, *, wished: Column, bottles: Column, tried: Column) -> DataFrame:
    """(profile, all_items, wished, owned, tried, bottles) over all items that a profile has wished, owned or tried."""
    items = rows.groupBy("profile", "item").agg(F.bool_or(wished).alias("w"), F.sum(bottles).alias("b"), F.bool_or(tried).alias("t")).where("w or b is not null or t")
    return items.groupBy("profile").agg(F.count("*").alias("all_items"), F.count_if("w").alias("wished"), F.count("b").alias("owned"), F.count_if("t").alias("tried"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("bottles"))


def balances(events: DataFrame, *, low: int = 0, high: int = 999) -> DataFrame:
    """(id, account, delta, balance, valid, undone): a ledger of (id, account, request, delta, undo_of).

    A request counts once, by its first event; an event can be undone once, by its first undo, which
    takes its delta back; other undos count nothing. valid: the balance stays in bounds.
    """
    first = F.row_number().over(Window.partitionBy("account", "request").orderBy("id"))
    once = events.withColumn("rn", first).where("rn = 1").drop("rn")
    undos = once.where("undo_of is not null").withColumn("rn", F.row_number().over(Window.partitionBy("account", "undo_of").orderBy("id"))).where("rn = 1")
    target = once.where("undo_of is null").select(F.col("account").alias("ta"), F.col("id").alias("ti"), F.col("delta").alias("td"))
    taken = undos.join(target, (F.col("ta") == F.col("account")) & (F.col("ti") == F.col("undo_of")) & (F.col("ti") < F.col("id"))).select("id", "account", (-F.col("td")).alias("delta"), "undo_of")
    undone = taken.select("account", F.col("undo_of").alias("id")).withColumn("undone", F.lit(True))
    plain = once.where("undo_of is null").join(undone, ["account", "id"], "left").select("id", "account", "delta", F.coalesce("undone", F.lit(False)).alias("undone"))
    both = plain.unionByName(taken.select("id", "account", "delta", F.lit(False).alias("undone")))
    line = Window.partitionBy("account").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("balance", F.sum("delta").over(line)).withColumn("valid", F.col("balance").between(low, high))


def journal(entries: DataFrame) -> DataFrame:
    """(id, key, state, payload): operations of a journal of (seq, id, kind, key, payload, inverse).

    kinds: begin, done, undo. Begun and not done is pending, to be recovered by its payload; done and
    undone is undone, and its inverse is the payload in force.
    """
    has = lambda k: F.bool_or(F.col("kind") == k)
    folded = entries.groupBy("id").agg(F.min_by("key", "seq").alias("key"), F.min_by("payload", "seq").alias("payload"), F.min_by("inverse", "seq").alias("inverse"), has("begin").alias("begun"), has("done").alias("done"), has("undo").alias("undone")).where("begun")
    state = F.when(F.col("done") & F.col("undone"), "undone").when(F.col("done"), "done").otherwise("pending")
    return folded.select("id", "key", state.alias("state"), F.when(state == "undone", F.col("inverse")).otherwise(F.col("payload")).alias("payload"))


def reviewed(items: DataFrame, actions: DataFrame) -> DataFrame:
    """(item, slug, status): items (item, slug) after their actions (seq, item, action, target).

    accept, reject and quarantine set the status, relabel and assign also the slug; the last action
    decides the status, the last relabel or assign the slug; without any an item is to be reviewed.
    """
    moved = F.col("action").isin("relabel", "assign")
    last = actions.groupBy("item").agg(F.max_by("action", "seq").alias("action"), F.max_by("target", F.when(moved, F.col("seq"))).alias("target"), F.bool_or(moved).alias("moved"))
    status = F.when(F.col("action").isin("accept", "relabel", "assign"), "accepted").when(F.col("action") == "reject", "rejected").when(F.col("action") == "quarantine", "quarantined").otherwise("needs_review")
    return items.join(last, "item", "left").select("item", F.when(F.col("moved"), F.col("target")).otherwise(F.col("slug")).alias("slug"), status.alias("status"))


def merged(left: DataFrame, right: DataFrame, key: list[str], policy: dict[str, str]) -> DataFrame:
    """One row a key of two tables, each column by its policy: max, sum, keep (left's unless null) or keep_nonzero (left's unless 0 or null)."""
    names = {c: f"_{c}" for c in policy}
    both = left.select(*key, *policy).join(right.select(*key, *[F.col(c).alias(n) for c, n in names.items()]), key, "full")
    rules = {
        "max": lambda a, b: F.greatest(a, b),
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "keep": lambda a, b: F.coalesce(a, b),
        "keep_nonzero": lambda a, b: F.coalesce(F.nullif(a, F.lit(0)), b, a),
    }
    return both.select(*key, *[rules[how](F.col(c), F.col(names[c])).alias(c) for c, how in policy.items()])


def reordered(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(list, ok, position, item): members in the wanted order (list, items) if it names exactly the members, else as they were."""
    held = members.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("rows"))
    now = F.transform("rows", lambda r: r["item"])
    both = held.join(wanted, "list", "left").withColumn("now", now)
    ok = F.coalesce(F.sort_array("items") == F.sort_array("now"), F.lit(False))
    return both.select("list", ok.alias("ok"), F.posexplode(F.when(ok, F.col("items")).otherwise(F.col("now"))).alias("position", "item"))


def reconciled(rows: DataFrame, evidence: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """(id, before, after) of rows (id, status) that a rule moves: (from status, condition on the joined evidence, new status), the first that fits."""
    joined = rows.join(evidence, "id", "left")
    after = F.lit(None).cast("string")
    for old, fits, new in reversed(rules):
        after = F.when((F.col("status") == old) & F.coalesce(fits, F.lit(False)), new).otherwise(after)
    return joined.select("id", F.col("status").alias("before"), F.coalesce(after, F.col("status")).alias("after"))


def reseeded(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """(list, change): which lists a seeding would write: new, changed (other members or order) or same, from (list, items)."""
    both = seeds.join(stored.withColumnRenamed("items", "old"), "list", "left")
    return both.select("list", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("items"), "same").otherwise("changed").alias("change"))


def thread(messages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Messages (conv, seq, author, text) with those deleted (conv, seq) kept in place without their text."""
    gone = deleted.select("conv", "seq").distinct().withColumn("gone", F.lit(True))
    return messages.join(gone, ["conv", "seq"], "left").select("conv", "seq", "author", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("text")).alias("text"), F.coalesce("gone", F.lit(False)).alias("deleted"))
