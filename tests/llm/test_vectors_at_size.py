"""Tables that grow with the vectors don't pass the driver, however small their files are."""

import numpy as np
import pytest

from leafmill.llm import common, embeddings


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _vectors(spark):
    x = np.random.default_rng(1).standard_normal((300, 8))
    x[200:] = x[:100] + 0.1 * x[100:200]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("cells", [1 << 16, 0])
def test_only_counts_of_few_cells_are_broadcast(spark, monkeypatch, cells):
    plans = {}

    def staged(df, label):
        plans.setdefault(label, []).append(_plan(df))
        return stage(df, label)

    stage = common.stage
    monkeypatch.setattr(embeddings, "stage", staged)
    monkeypatch.setattr(common, "stage", staged)
    monkeypatch.setattr(embeddings, "_CELLS", cells, raising=False)
    df, u = _vectors(spark)
    out = embeddings.link_vectors(df, embeddings.Pigeonhole(tile=40))
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist())) and sum(got.values()) > 100
    counts = {label: sum(p.count("BroadcastExchange") for p in found) for label, found in plans.items()}
    assert {k: n for k, n in counts.items() if n} == ({"links": 1} if cells else {})
    assert "BroadcastExchange" not in _plan(out)


def test_vectors_come_to_tiles_by_one_shuffle(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(embeddings, "stage", lambda df, label, stage=common.stage: plans.update({label: _plan(df)}) or stage(df, label))
    embeddings.link_vectors(_vectors(spark)[0])
    assert plans["links"].count("Exchange hashpartitioning") == 1
