"""Tables that several branches of a job read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame


class Made(Mapping):
    """Tables by name, each made when it is first asked for, so that nothing is computed for those that are not."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers = {name: cache(make) for name, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def kept(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir and read back; without such a folder only local mode makes one.

    The lineage is cut and the rows survive lost executors. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/leafmill/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df, dealt by columns over as many tasks as spark.sql.shuffle.partitions says, however few bytes it has: for rows that few bytes make much work of."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
