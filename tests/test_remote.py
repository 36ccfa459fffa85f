import json

import pandas as pd

from larkspur.sources import remote


def test_paged_json(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"items": [{"id": n * 10 + k} for k in range(2)]}))
    spark.dataSource.register(remote.PagedJson)
    rows = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("last", "3").option("items", "items").load().collect()
    assert sorted((r.page, json.loads(r["item"])["id"]) for r in rows) == [(1, 10), (1, 11), (2, 20), (2, 21), (3, 30), (3, 31)]


def test_remote_errors_become_rows(spark):
    def client():
        def call(batch: pd.DataFrame) -> pd.DataFrame:
            if (batch["id"] == 3).any():
                raise ValueError("refused")
            return pd.DataFrame({"score": batch["id"] * 2.0})

        return call

    rows = remote.scored_remotely(spark.range(0, 4, 1, 4), client, "score double").collect()
    assert sorted((r.id, r.score, r.error) for r in rows) == [(0, 0.0, None), (1, 2.0, None), (2, 4.0, None), (3, None, "ValueError")]
