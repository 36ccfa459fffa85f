"""State from events: ledgers, folds, merges, reconciliation; and their streaming forms."""

from pyspark.sql import functions as F

from larkspur.operators import ledger
from larkspur.plans.shared import Catalogue
from larkspur.sources.versioned import VersionedTable
from larkspur.storage import scratch, table
from larkspur.streaming import accounts, activity

C = Catalogue()
QUERIES, ORACLES, COVERS = C.QUERIES, C.ORACLES, C.COVERS

C.sql("version_audit", "K4", """
WITH v AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) AS version FROM {lineitem})
SELECT l_partkey, max(version) AS versions, count(*) FILTER (WHERE version > 1) AS edits FROM v GROUP BY l_partkey""")
C.sql("upsert_latest", "K1", """
WITH u AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS seq FROM {customer} UNION ALL SELECT o_custkey, o_totalprice, o_orderkey + 1 FROM {orders} WHERE o_orderstatus = 'P')
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM u) x WHERE rn = 1""")
@C.query("stored_upsert", "K1 K8 A20", """
WITH c AS (SELECT o_custkey AS k, o_orderkey, o_totalprice AS v, o_orderstatus AS s FROM orders),
r AS (SELECT k, v, 'order' AS origin FROM c WHERE s = 'P' QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) = 1),
one AS (SELECT c_custkey AS k, c_acctbal AS v, 'base' AS origin FROM customer WHERE c_custkey NOT IN (SELECT k FROM r) UNION ALL SELECT * FROM r),
g AS (SELECT k + 100 AS k, v, 'new' AS origin FROM c WHERE s = 'F' QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1)
SELECT * FROM one UNION ALL SELECT * FROM g WHERE k NOT IN (SELECT k FROM one)""")
def stored_upsert(spark, sf_dir):
    """A stored table of balances: the latest pending order of a customer replaces its row, filled orders only add keys."""
    stored = VersionedTable(spark, scratch(spark, "stored"))
    stored.create(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("base").alias("origin")), ["k"])
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey", "o_orderstatus")
    stored.upsert(orders.where("o_orderstatus = 'P'").withColumn("origin", F.lit("order")), order=["o_orderkey"])
    stored.upsert(orders.where("o_orderstatus = 'F'").withColumn("k", F.col("k") + 100).withColumn("origin", F.lit("new")), order=["o_orderkey"], policy="ignore")
    return stored.read()


C.sql("status_transitions", "K10", """
WITH t AS (SELECT user_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events})
SELECT before, now, count(*) AS n FROM t WHERE before IS NOT NULL AND before <> now GROUP BY before, now""")
C.sql("resume_todo", "C6", """
SELECT p.page_id, lower(EXTRACT(url, '//([^/:?#]*)', 1)) AS host FROM {pages} p WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = p.page_id AND d.n_chars > 5000)""")
C.sql("manifest_check", "A7", """
SELECT count(*) AS n, count(DISTINCT doc_id) AS keys, count(*) = count(DISTINCT doc_id) AS valid FROM {documents}""")


@C.query("windowed_activity", "streaming D5 E17", """
SELECT CAST(floor(SECONDS(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2""")
def windowed_activity(spark, sf_dir):
    """Hourly counts of the event log, run as a stream to its end."""
    return activity.hourly(table(spark, sf_dir, "events"), f"{sf_dir}/events.parquet")


_LEDGER = "e AS (SELECT event_id AS id, user_id AS account, json_extract_string(props, '$.k') || event_type AS request, CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS delta, CASE WHEN event_type = 'error' THEN event_id - event_id % 40 END AS undo_of FROM events)"


def _ledger_events(events):
    """The event log as a ledger: what moves an account, under which request, and what an error takes back."""
    kind = F.col("event_type")
    delta = F.when(kind == "purchase", 3).when(kind == "view", 1).when(kind == "click", -1).otherwise(0)
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("account"), F.concat(F.get_json_object("props", "$.k"), kind).alias("request"), delta.alias("delta"), F.when(kind == "error", F.col("event_id") - F.col("event_id") % 40).alias("undo_of"), F.col("ts").cast("timestamp").alias("ts"))


@C.query("ledger_balance", "K3", f"""
WITH {_LEDGER}, o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY account, request ORDER BY id) = 1), u AS (SELECT * FROM o WHERE undo_of IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account, undo_of ORDER BY id) = 1),
t AS (SELECT u.id, u.account, -o.delta AS delta, u.undo_of FROM u JOIN o ON o.account = u.account AND o.id = u.undo_of AND o.undo_of IS NULL AND o.id < u.id),
b AS (SELECT id, account, delta, EXISTS (SELECT 1 FROM t WHERE t.account = o.account AND t.undo_of = o.id) AS undone FROM o WHERE undo_of IS NULL UNION ALL SELECT id, account, delta, false FROM t)
SELECT id, account, delta, undone, sum(delta) OVER (PARTITION BY account ORDER BY id)::BIGINT AS balance, sum(delta) OVER (PARTITION BY account ORDER BY id) BETWEEN 0 AND 999 AS valid FROM b""")
def ledger_balance(spark, sf_dir):
    """Running balances with each request once, undone events taken back once, and bounds checked."""
    return ledger.balances(_ledger_events(table(spark, sf_dir, "events")))


@C.query("ledger_stream", "K3 E17 B10 streaming", f"""
WITH {_LEDGER}, n AS (SELECT e.*, ts, row_number() OVER (PARTITION BY account, request ORDER BY id) AS nth FROM e JOIN events ON event_id = id),
u AS (SELECT id, account, undo_of FROM n WHERE nth = 1 AND undo_of IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account, undo_of ORDER BY id) = 1),
t AS (SELECT u.id, -o.delta AS delta FROM u JOIN n o ON o.account = u.account AND o.id = u.undo_of AND o.undo_of IS NULL AND o.nth = 1 AND o.id < u.id),
s AS (SELECT account, n.id, ts, CASE WHEN nth > 1 THEN 'repeat' WHEN t.id IS NOT NULL THEN 'undo' WHEN undo_of IS NOT NULL THEN 'ignored' ELSE 'applied' END AS status, CASE WHEN nth > 1 THEN 0 ELSE coalesce(t.delta, CASE WHEN undo_of IS NULL THEN n.delta ELSE 0 END) END::BIGINT AS delta FROM n LEFT JOIN t ON t.id = n.id)
SELECT account, id, status, delta, sum(delta) OVER (PARTITION BY account ORDER BY id)::BIGINT AS balance, sum(delta) OVER (PARTITION BY account ORDER BY id) BETWEEN 0 AND 999 AS valid, coalesce(ts - lag(ts, 8) OVER (PARTITION BY account ORDER BY ts, id) <= INTERVAL 1 DAY, false) AS limited FROM s""")
def ledger_stream(spark, sf_dir):
    """The ledger as a stateful stream over the event log, run to its end and closed; at most 8 events a day."""
    return accounts.run(spark, f"{sf_dir}/events.parquet", _ledger_events, scratch(spark, "ledger"), close=True, window=86400, slot=86400)


@C.query("journal_state", "K5", """
WITH j AS (SELECT event_id AS seq, event_id // 3 AS id, CASE event_type WHEN 'view' THEN 'begin' WHEN 'signup' THEN 'begin' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'done' ELSE 'undo' END AS kind, user_id AS key, event_type AS payload, 'not ' || event_type AS inverse FROM events),
f AS (SELECT id, arg_min(key, seq) AS key, arg_min(payload, seq) AS payload, arg_min(inverse, seq) AS inverse, bool_or(kind = 'done') AS done, bool_or(kind = 'undo') AS undone FROM j GROUP BY id HAVING bool_or(kind = 'begin'))
SELECT id, key, CASE WHEN done AND undone THEN 'undone' WHEN done THEN 'done' ELSE 'pending' END AS state, CASE WHEN done AND undone THEN inverse ELSE payload END AS payload FROM f""")
def journal_state(spark, sf_dir):
    """Operations of a journal: pending, done or undone, with the payload in force."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "begin").when(F.col("event_type").isin("click", "purchase"), "done").otherwise("undo")
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("id"), kind.alias("kind"), F.col("user_id").alias("key"), F.col("event_type").alias("payload"), F.concat(F.lit("not "), "event_type").alias("inverse"))
    return ledger.journal(entries)


@C.query("review_states", "K6 C25", """
WITH a AS (SELECT event_id AS seq, event_id % 50 AS item, CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'relabel' WHEN 'purchase' THEN 'assign' WHEN 'error' THEN 'reject' ELSE 'quarantine' END AS action, 's' || user_id AS target FROM events WHERE event_id % 50 < 40),
l AS (SELECT item, arg_max(action, seq) AS action, arg_max(target, seq) FILTER (WHERE action IN ('relabel', 'assign')) AS target FROM a GROUP BY item)
SELECT p_partkey AS item, coalesce(target, p_brand) AS slug, CASE WHEN action IN ('accept', 'relabel', 'assign') THEN 'accepted' WHEN action = 'reject' THEN 'rejected' WHEN action = 'quarantine' THEN 'quarantined' ELSE 'needs_review' END AS status FROM part LEFT JOIN l ON item = p_partkey""")
def review_states(spark, sf_dir):
    """Status and label of items after their review log."""
    kind = F.col("event_type")
    action = F.when(kind == "view", "accept").when(kind == "click", "relabel").when(kind == "purchase", "assign").when(kind == "error", "reject").otherwise("quarantine")
    actions = table(spark, sf_dir, "events").where("event_id % 50 < 40").select(F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("item"), action.alias("action"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("target"))
    return ledger.reviewed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("slug")), actions)


_SIDE = "SELECT o_custkey % 500 AS profile, l_partkey AS item, (max(l_quantity) > 40)::INT AS favorite, CASE WHEN max(l_quantity)::INT % 3 = 0 THEN 0 ELSE max(l_quantity)::INT % 5 END AS rating, sum(l_quantity)::BIGINT AS quantity, min(l_shipmode) AS note FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = '{0}' AND l_partkey % 10 = 1 GROUP BY 1, 2".replace("min(l_shipmode)", "min(l_returnflag)")


@C.query("profile_merge", "K2", f"""
WITH a AS ({_SIDE.format('F')}), b AS ({_SIDE.format('O')})
SELECT profile, item, CASE WHEN a.favorite IS NULL THEN b.favorite WHEN b.favorite IS NULL THEN a.favorite ELSE greatest(a.favorite, b.favorite) END AS favorite, coalesce(nullif(a.rating, 0), b.rating, a.rating) AS rating, coalesce(a.quantity, 0) + coalesce(b.quantity, 0) AS quantity, coalesce(a.note, b.note) AS note FROM a FULL JOIN b USING (profile, item)""")
def profile_merge(spark, sf_dir):
    """A guest's records into an account's, each column by its policy."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_partkey % 10 = 1")
    most = F.max("l_quantity").cast("int")

    def side(status):
        rows = lines.where(F.col("l_linestatus") == status).groupBy((F.col("o_custkey") % 500).alias("profile"), F.col("l_partkey").alias("item"))
        return rows.agg((F.max("l_quantity") > 40).cast("int").alias("favorite"), F.when(most % 3 == 0, 0).otherwise(most % 5).alias("rating"), F.sum("l_quantity").cast("long").alias("quantity"), F.min("l_returnflag").alias("note"))

    return ledger.merged(side("F"), side("O"), ["profile", "item"], {"favorite": "max", "rating": "keep_nonzero", "quantity": "sum", "note": "keep"})


@C.query("list_reorder", "K9", """
WITH m AS (SELECT l_orderkey AS list, l_partkey AS item, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2), h AS (SELECT list, list(item ORDER BY position, item) AS now FROM m GROUP BY list),
w AS (SELECT list, CASE WHEN list % 5 = 0 THEN list_slice(list_reverse(now), 1, len(now) - 1) ELSE list_reverse(now) END AS items FROM h WHERE list % 3 = 0),
r AS (SELECT list, coalesce(list_sort(items) = list_sort(now), false) AS ok, now, items FROM h LEFT JOIN w USING (list)), c AS (SELECT list, ok, CASE WHEN ok THEN items ELSE now END AS s FROM r)
SELECT list, ok, (unnest(generate_series(1, len(s))) - 1)::INTEGER AS position, unnest(s) AS item FROM c""")
def list_reorder(spark, sf_dir):
    """New orders of lists, taken only if they name exactly the members; every fifth lacks one."""
    members = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("list"), F.col("l_partkey").alias("item")).agg(F.min("l_linenumber").alias("position"))
    back = members.where("list % 3 = 0").groupBy("list").agg(F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("position", "item"))), lambda r: r["item"])).alias("items"))
    wanted = back.select("list", F.when(F.col("list") % 5 == 0, F.slice("items", F.lit(1), F.size("items") - 1)).otherwise(F.col("items")).alias("items"))
    return ledger.reordered(members, wanted)


@C.query("reconcile_status", "K10", """
WITH e AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS done, max(l_discount) AS top FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS id, o_orderstatus AS before, CASE WHEN o_orderstatus = 'O' AND done = n THEN 'F' WHEN o_orderstatus = 'O' AND done > 0 THEN 'P' WHEN o_orderstatus = 'F' AND top >= 0.1 THEN 'review' WHEN o_orderstatus = 'P' AND done = n THEN 'F' ELSE o_orderstatus END AS after FROM orders LEFT JOIN e ON id = o_orderkey)
SELECT before, after, count(*) AS n FROM r WHERE before <> after GROUP BY before, after""")
def reconcile_status(spark, sf_dir):
    """Status changes that the lines of orders call for, counted by transition."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.max("l_discount").alias("top"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    rules = [("O", F.col("done") == F.col("n"), "F"), ("O", F.col("done") > 0, "P"), ("F", F.col("top") >= 0.1, "review"), ("P", F.col("done") == F.col("n"), "F")]
    return ledger.reconciled(rows, seen, rules).where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


@C.query("seed_differences", "K11", """
WITH a AS (SELECT l_orderkey AS list, list(l_partkey ORDER BY l_linenumber, l_partkey) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey AS list, list(l_partkey ORDER BY l_linenumber, l_partkey) AS m FROM lineitem GROUP BY 1)
SELECT list, CASE WHEN a.m IS NULL THEN 'new' WHEN a.m = b.m THEN 'same' ELSE 'changed' END AS change FROM b LEFT JOIN a USING (list)""")
def seed_differences(spark, sf_dir):
    """Which lists a seeding writes: those whose ordered members differ."""
    lines = table(spark, sf_dir, "lineitem")
    held = lambda df: df.groupBy(F.col("l_orderkey").alias("list")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"]).alias("items"))
    return ledger.reseeded(held(lines.where("l_linestatus = 'F'")), held(lines))


@C.query("thread_messages", "K8 C5", """
SELECT conv_id AS conv, turn AS seq, role AS author, CASE WHEN turn % 4 = 2 THEN NULL ELSE text END AS text, turn % 4 = 2 AS deleted FROM conversations""")
def thread_messages(spark, sf_dir):
    """Threads with deleted messages kept in place without their text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), F.col("role").alias("author"), "text")
    return ledger.thread(rows, rows.where("seq % 4 = 2"))
