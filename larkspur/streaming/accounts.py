"""A ledger of accounts as a stateful stream: events in order of time, each request once, undo once, bounds and a rate.

Events wait in state until the watermark has passed their slot of time, so input may come in any order within
the lateness; what comes later is dropped by the watermark. A restart from the checkpoint goes on where it was.
"""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from larkspur.streaming.activity import follow

_EVENT = "at:long,id:long,request:string,delta:long,undo_of:long"
SETTLED = "account long, id long, status string, delta long, balance long, valid boolean, limited boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class AccountLedger(StatefulProcessor):
    """State of an account: events that wait, requests and entries seen, undone entries, the balance and the last few times."""

    def __init__(self, low: int, high: int, limit: int, window: int, slot: int, keep: int | None):
        self.low, self.high, self.limit = low, high, limit
        self.window, self.slot = window * 1_000_000, slot * 1_000_000
        self.keep = None if keep is None else keep * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", f"events array<struct<{_EVENT}>>")
        self.requests = handle.getMapState("requests", "request string", "at long")
        self.entries = handle.getMapState("entries", "id long", "at long, delta long")
        self.undos = handle.getMapState("undos", "id long", "at long")
        self.account = handle.getValueState("account", "balance long, swept long, recent array<long>")

    def handleInputRows(self, key, rows, timerValues):
        slots = defaultdict(list)
        for r in rows:
            if key[0] is not None and r.id is not None:
                slots[r.at // self.slot].append((r.at, r.id, r.request, r.delta, r.undo_of))
        for slot, events in slots.items():
            held = self.waiting.getValue((slot,))
            self.waiting.updateValue((slot,), ([*(map(tuple, held[0]) if held else ()), *events],))
            self.handle.registerTimer((slot + 1) * self.slot // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        slot = (now // self.slot - 1,)
        balance, swept, recent = self.account.get() if self.account.exists() else (0, now, [])
        recent, out = list(recent), []
        if held := self.waiting.getValue(slot):
            self.waiting.removeKey(slot)
            for at, event, request, delta, undo_of in sorted(map(tuple, held[0]), key=lambda e: e[:2]):
                recent.append(at)
                limited = len(recent) > self.limit and at - recent[-1 - self.limit] <= self.window
                del recent[: -self.limit]
                status, change = self._applied(at, event, request, delta, undo_of)
                balance += change
                out.append(Row(account=key[0], id=event, status=status, delta=change, balance=balance, valid=self.low <= balance <= self.high, limited=limited))
            if self.keep is not None:
                self.handle.registerTimer(-(-(now + self.keep) // self.slot) * self.slot // 1000)
        if self.keep is not None and now - swept >= self.keep:
            swept = now
            for state in (self.requests, self.entries, self.undos):
                for old in [k for k, v in state.iterator() if now - v[0] > self.keep]:
                    state.removeKey(old)
        self.account.update((balance, swept, recent))
        return iter(out)

    def _held(self, state, key, at):
        """The value under the key unless its time to live is over."""
        value = state.getValue((key,))
        return value if value and (self.keep is None or at - value[0] <= self.keep) else None

    def _applied(self, at, event, request, delta, undo_of):
        if self._held(self.requests, request, at):
            return "repeat", 0
        self.requests.updateValue((request,), (at,))
        if undo_of is None:
            self.entries.updateValue((event,), (at, delta))
            return "applied", delta
        first = not self._held(self.undos, undo_of, at)
        if first:
            self.undos.updateValue((undo_of,), (at,))
        target = self._held(self.entries, undo_of, at) if first else None
        return ("undo", -target[1]) if target else ("ignored", 0)


def settled(events: DataFrame, *, lateness: str = "1 hour", low: int = 0, high: int = 999, limit: int = 8, window: int = 60, slot: int = 60, keep: int | None = None) -> DataFrame:
    """One row (SETTLED) an event of a stream of (account, id, request, delta, undo_of, ts), in order of (ts, id) by account.

    status: repeat (the account's request was seen), undo (takes back the delta of an earlier entry, by its first
    undo), ignored (another undo) or applied. valid: the balance is within low and high. limited: more than
    `limit` events within `window` seconds. With `keep`, requests, entries and undos are forgotten after so
    many seconds of event time. A null request is a request; rows with a null account, id or ts give nothing.
    """
    timed = events.withColumn("delta", F.coalesce("delta", F.lit(0)).cast("long")).withColumn("at", F.unix_micros("ts"))
    return (
        timed.withWatermark("ts", lateness)
        .groupBy("account")
        .transformWithState(statefulProcessor=AccountLedger(low, high, limit, window, slot, keep), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime")
    )


@contextmanager
def _state_in_files(spark: SparkSession):
    """State of many kinds a key needs the provider that spills to files; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run(spark: SparkSession, path: str, as_events, out: str, *, close: bool, options: dict | None = None, **settings) -> DataFrame:
    """Settle what is new in a Parquet path into out/rows, from the checkpoint in out/state; close: release all that waits.

    A closed ledger takes no more events: its watermark stands at the end of time.
    """
    closing = f"{out}/closing"
    schema = "account long, id long, request string, delta long, undo_of long, ts timestamp"
    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").parquet(closing)

    def once():
        stream = as_events(follow(spark, path, options)).unionByName(spark.readStream.schema(schema).parquet(closing))
        sink = settled(stream, **settings).writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
        sink.start(f"{out}/rows", format="parquet", outputMode="append").awaitTermination()

    with _state_in_files(spark):
        once()
        if close:
            spark.sql("SELECT CAST(NULL AS BIGINT) AS account, CAST(NULL AS BIGINT) AS id, '' AS request, 0L AS delta, CAST(NULL AS BIGINT) AS undo_of, TIMESTAMP '9000-01-01' AS ts").write.mode("append").parquet(closing)
            once()
    return spark.read.schema(SETTLED).parquet(f"{out}/rows")
