"""Kernel distance against its definition."""

import random

import numpy as np

from strataloom.plans import inference


def test_kernel_distance_has_an_error_and_counts_the_unpaired(spark, tmp_path):
    pick = random.Random(2)
    rows = [(i, 1, [pick.gauss(0, 1) for _ in range(4)]) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12)] + [(20, 2, [1.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, y = (np.array([e for i, label, e in rows if label == 1 and i % 2 == half][:4]) for half in (0, 1))
    kernel = lambda a, b: (a @ b.T / 4 + 1) ** 3
    h = kernel(x, x) + kernel(y, y) - kernel(x, y) - kernel(x, y).T
    np.fill_diagonal(h, 0)
    h1 = h.sum(axis=1) / 3
    got = {r.label: r for r in inference.kernel_distance_whole(spark, str(tmp_path)).collect()}
    assert (got[1].n, got[1].unpaired) == (4, 3) and (got[2].n, got[2].kid, got[2].unpaired) == (0, None, 1)
    assert abs(got[1].kid - h1.mean()) < 1e-7 and abs(got[1].se - 2 * np.sqrt(h1.var(ddof=1) / 4)) < 1e-7
