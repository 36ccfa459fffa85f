"""Resumable fetching: only the rest is asked, in order, at a rate by host, errors as rows."""

import pytest

from larkspur.sources import fetching


@pytest.fixture
def site(tmp_path):
    (tmp_path / "site").mkdir()
    for i in range(12):
        (tmp_path / "site" / f"{i}").write_text(f"page {i}")

    def run(spark, keys, **options):
        url = lambda i: f"file://{tmp_path}/site/{i}"
        rows = spark.createDataFrame([(str(i), "a" if i < 9 else "b", url(i)) for i in keys], "key string, host string, url string")
        fetching.enqueue(rows, f"file://{tmp_path}/queue", tasks=2)
        return again(spark, **options)

    def again(spark, **options):
        at = {n: f"file://{tmp_path}/{n}" for n in ("queue", "cache", "log", "checkpoint")}
        return fetching.fetch(spark, **at, tasks=2, **{"rate": 1000} | options).collect()

    run.again, run.path = again, tmp_path
    return run


def test_restart_fetches_only_the_rest(spark, site):
    first = site(spark, range(6))
    assert sorted((r.key, r.body.decode(), r.cached) for r in first) == sorted((str(i), f"page {i}", False) for i in range(6))
    assert len(site.again(spark)) == 6
    for i in range(6):
        (site.path / "site" / f"{i}").unlink()
    both = site(spark, range(6, 12))
    assert sorted(int(r.key) for r in both) == list(range(12)) and not any(r.error for r in both)


def test_cache_serves_what_a_lost_checkpoint_asks_again(spark, site):
    site(spark, range(4))
    (site.path / "checkpoint").rename(site.path / "lost")
    (site.path / "log").rename(site.path / "old-log")
    again = site.again(spark)
    assert len(again) == 4 and all(r.cached for r in again)


def test_errors_are_rows_and_can_be_asked_again(spark, site):
    rows = site(spark, [1, 99])
    assert [(r.key, r.body, r.error) for r in rows if r.error] == [("99", None, "URLError")]
    (site.path / "site" / "99").write_text("late")
    assert [r.body.decode() for r in site(spark, [99]) if r.key == "99" and not r.error] == ["late"]


def test_rate_and_order_of_a_host(spark, site):
    rows = sorted(site(spark, range(12), rate=10), key=lambda r: r.at)
    own = [r for r in rows if r.host == "a"]
    assert [int(r.key) for r in own] == list(range(9))
    assert all(y.at - x.at >= 0.09 for x, y in zip(own, own[1:], strict=False))


def test_nulls_are_refused(spark, site):
    with pytest.raises(ValueError, match="null"):
        fetching.enqueue(spark.createDataFrame([(None, "a", "u")], "key string, host string, url string"), f"file://{site.path}/q")
