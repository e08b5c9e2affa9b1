"""What several operators of this package share."""

from __future__ import annotations

import pickle
import re

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit integers, another one for each seed (wraps around on purpose)."""
    seed = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


#: Steps in which the share of a sample is set, far more than there are rows.
SHARES = 10**15


def sample_slots(wanted: float, rows: int) -> int:
    """Of ``SHARES`` slots so many that ``wanted`` of the rows fall into them, and one at least."""
    return SHARES if rows <= wanted else max(1, int(SHARES * (wanted / rows)))


def ship(spark: SparkSession, value: object) -> Broadcast[bytes]:
    """A broadcast that a worker can read which cannot import the class of the value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent: Broadcast[bytes]) -> object:
    return pickle.loads(sent.value)


def spread(rows: int, per_partition: int, least: int) -> int:
    """Partitions for so many rows: it grows with them and never falls below ``least``."""
    return max(least, -(-rows // per_partition))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_hex(column: str | Column) -> Column:
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)
