"""Repeated rows of one vector, and many points at one distance."""

import numpy as np
from pyspark.sql import functions as F

from proofline.llm import neighbours


def test_repeated_rows_hide_no_equal_vector(spark):
    rows = [(0, [1.0, 2.0])] * 15 + [(i, [1.0, 2.0]) for i in range(1, 21)] * 2 + [(200, [1.0, 2.5])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 20).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(i + 1, i, 0.0) for i in range(10)]


def test_the_smallest_ids_of_one_distance(spark):
    """The query's 40 neighbours at distance one are not told apart by anything but their ids."""
    ring = np.concatenate([np.eye(20), -np.eye(20)]) + 2
    order = np.random.default_rng(1).permutation(40)
    rows = [(1000, [2.0] * 20)] + [(int(i), ring[j].tolist()) for i, j in enumerate(order)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") == 1000).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in found) == [(i + 1, i) for i in range(10)]
