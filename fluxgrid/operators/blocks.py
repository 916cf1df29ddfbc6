"""A set of queries against all rows, block by block: Spark pairs blocks with groups, tasks multiply them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_blocks(queries: DataFrame, rows: DataFrame, by_query: Column, by_row: Column, blocks: int, groups: int, scan: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``scan`` of every block of ``queries`` with every group of ``rows``.

    Rows go to ``blocks`` and ``groups`` by a hash of what ``by_query`` and ``by_row`` say. A task holds one
    block and one group, whose sizes don't grow with the tables; the driver sees neither. What is shuffled is
    each side times the number of parts of the other, little against the work of multiplying them.
    """
    place = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spark = queries.sparkSession
    tasks = min(blocks * groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    q = queries.withColumn("_block", place(by_query, blocks)).withColumn("_group", every(groups)).repartition(tasks, "_block", "_group")
    r = rows.withColumn("_group", place(by_row, groups)).withColumn("_block", every(blocks)).repartition(tasks, "_block", "_group")
    return q.groupBy("_block", "_group").cogroup(r.groupBy("_block", "_group")).applyInArrow(scan, schema)


def top_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest values of each row; of equal ones those further left."""
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    keep = scores >= least
    for i in np.flatnonzero(keep.sum(axis=1) > k):
        tied = np.flatnonzero(scores[i] == least[i])
        keep[i, tied[k - int((scores[i] > least[i]).sum()) :]] = False
    return np.nonzero(keep)
