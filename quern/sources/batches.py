"""What Python workers get at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Most bytes of rows that Python workers get at a time, however long the rows are.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session, as Spark's own bound by rows lets them grow with the texts' lengths; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None or not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def mapped(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``rows.mapInPandas`` over batches that are bounded by bytes."""
    bounded(rows.sparkSession)
    return rows.mapInPandas(run, schema)
