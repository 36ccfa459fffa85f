"""The ledger stream against a plain loop: input out of order, a restart, a time to live, and its query against SQL."""

import datetime as dt
import random

import pytest
from oracle import connect, same

from larkspur.plans import registry
from larkspur.streaming import accounts

START = dt.datetime(2024, 1, 1)
SCHEMA = "account long, id long, request string, delta int, undo_of long, ts timestamp"


def loop(rows, low, high, limit, window, keep):
    state, out = {}, []
    for account, event, request, delta, undo_of, ts in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[5], r[1])):
        seen, entries, undos, times, total = state.setdefault(account, ({}, {}, {}, [], [0]))
        live = lambda held: held is not None and (keep is None or (ts - held[0]).total_seconds() <= keep)  # noqa: E731, B023
        times.append(ts)
        limited = len(times) > limit and (ts - times[-1 - limit]).total_seconds() <= window
        status, change = "repeat", 0
        if not live(seen.get(request)):
            seen[request] = (ts,)
            if undo_of is None:
                status, change = "applied", delta or 0
                entries[event] = (ts, change)
            else:
                status = "ignored"
                if not live(undos.get(undo_of)):
                    undos[undo_of] = (ts,)
                    if live(entries.get(undo_of)):
                        status, change = "undo", -entries[undo_of][1]
        total[0] += change
        out.append((account, event, status, change, total[0], low <= total[0] <= high, limited))
    return sorted(out)


def events(n, seed):
    pick = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += dt.timedelta(seconds=pick.choice([0, 1, 5, 40]))
        undo = pick.randrange(max(0, i - 12), i + 2) if pick.random() < 0.3 else None
        rows.append((pick.choice([1, 1, 1, 2, 3]), i, pick.choice([None, *"abcdefghijklmnopqrstuvw"]) if pick.random() < 0.4 else f"r{i}", pick.choice([3, 1, -2, -4, None]), undo, at))
    return [*rows, (None, n, "r", 1, None, START)]


@pytest.mark.parametrize("keep", [None, 200])
def test_out_of_order_and_restarted(spark, tmp_path, keep):
    rows = events(150, 5)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    settings = {"low": 0, "high": 12, "limit": 3, "window": 60, "keep": keep}
    for k in range(2):  # a run of its own for each half: the second goes on from the checkpoint
        spark.createDataFrame(mixed[k::2], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
        got = accounts.run(spark, f"{tmp_path}/in.parquet", lambda df: df, f"{tmp_path}/out", close=k == 1, lateness="2 days", slot=30, **settings)
    want = loop(rows, **settings)
    assert sorted(map(tuple, got.collect())) == want
    assert {r[2] for r in want} == {"applied", "repeat", "undo", "ignored"} and {r[6] for r in want} == {True, False}


def test_late_rows_are_dropped(spark, tmp_path):
    old, new = (1, 0, "a", 5, None, START), (1, 1, "b", 1, None, START + dt.timedelta(hours=5))
    for k, row in enumerate((new, old)):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
        got = accounts.run(spark, f"{tmp_path}/in.parquet", lambda df: df, f"{tmp_path}/out", close=k == 1, lateness="1 hour")
    assert [r["id"] for r in got.collect()] == [1]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in.parquet")
    assert accounts.run(spark, f"{tmp_path}/in.parquet", lambda df: df, f"{tmp_path}/out", close=True).count() == 0


def test_equals_the_batch_ledger(spark, sf_dir):
    stream = registry.QUERIES["ledger_stream"](spark, sf_dir)
    batch = registry.QUERIES["ledger_balance"](spark, sf_dir).select("account", "id", "delta", "balance")
    kept = stream.where("status in ('applied', 'undo')").select("account", "id", "delta", "balance")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, batch.collect()))
    same(stream, connect(sf_dir), registry.ORACLES["ledger_stream"])
