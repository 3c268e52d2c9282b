"""Planted links among vectors of 64 components, by brute force; columns of clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import embeddings


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile", [16384, 150])
def test_planted_links(spark, kind, tile):
    rng = np.random.default_rng(64)
    base = rng.standard_normal((500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = []
    for i in range(120):  # cosines from well under to well over the threshold, with lengths of their own
        c = 0.8 + 0.199 * i / 119
        side = rng.standard_normal(64)
        side -= (side @ base[i]) * base[i]
        near.append((c * base[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)) * rng.uniform(0.01, 100))
    x = np.concatenate([base, near, np.repeat(base[200:201], 80, 0)])
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    for _ in range(8):
        comp = np.minimum(comp, np.where(linked, comp[None, :], len(x)).min(1))
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(10_000 + i, None, "b") for i in range(50)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string").withColumns({c: F.lit(1) for c in ("vector", "width", "_rid", "mult", "block", "cell", "role", "n_links", "kept")})
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.link_vectors(df, embeddings.Pigeonhole(tile=tile)).collect())
    assert got == [(i, int(linked[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))] + [(10_000 + i, 0, 10_000 + i, True) for i in range(50)]
    assert sum(linked.sum(1) > 0) > 150
