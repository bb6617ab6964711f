import numpy as np

from corvex.llm import neighbours


def test_crowded_buckets_keep_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 250)
    rng = np.random.default_rng(3)
    x = rng.standard_normal(64) + 0.3 * rng.standard_normal((600, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = 1 - x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(d, 9)
    order = np.argsort(d, axis=1)[:, :10]
    assert 0.03 < np.median(np.sort(d, axis=1)[:, 9]) < 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, vector array<float>")
    found = {tuple(r) for r in neighbours.near_pairs(df, "node_id", "vector", functions=2, width=3.2, tables=4, probes=2, hot=60).collect()}
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in order[i]}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)
