"""Plan helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan over all cores before costly Python work, but only where its files give fewer partitions than cores.

    A scan with fewer partitions than cores is small (a partition holds at most spark.sql.files.maxPartitionBytes or one row
    group), so what is shuffled is bounded; larger scans stay as they are, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def by_group(rows: DataFrame, key: str, run: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str) -> DataFrame:
    """Grouped work with little cost a group: ``run`` gets a frame of whole groups and their (start, end) places.

    Rows are shuffled by key and sorted within partitions; a group that crosses Arrow batches is put together first.
    Meant for groups of a bounded size.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            k = frame[key].to_numpy()
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return run(frame.reset_index(drop=True), list(zip(at.tolist(), [*at[1:].tolist(), len(k)])))

        for b in batches:
            if not len(b):
                continue
            k = b[key].to_numpy()
            if held and held[-1][key].iloc[-1] != k[0]:
                yield done(pd.concat(held))
                held = []
            last = int(np.flatnonzero(k == k[-1])[0])
            if last:
                yield done(pd.concat([*held, b.iloc[:last]]))
                held = [b.iloc[last:]]
            else:
                held.append(b)
        if held:
            yield done(pd.concat(held))

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(work, schema)
