"""What the operators of this subpackage share: reading, settling and hashing of words."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: One random value a byte; A-Z count as a-z.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: Bytes of words that white space ends.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of ASCII letters, digits and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """A column name that is not among the columns: the name, with as many underscores as it takes."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, else one of this machine if all runs on it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="siltstone-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


#: Settings under which a step runs: Spark removes the files of its shuffles when it ends, and hands Python few texts at a time.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def as_step(spark: SparkSession) -> Iterator[None]:
    """Run what is inside under the settings of a step."""
    before = {k: spark.conf.get(k) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, its lineage cut.

    The files of the shuffles that led to df are removed as soon as it is kept: jobs of many steps would otherwise fill the
    executors' disks with them.
    """
    spark = df.sparkSession
    shared_folder(spark)
    with as_step(spark):
        return df.select("*").checkpoint(eager=True)  # select: a query of its own, made under the settings


def to_driver(df: DataFrame) -> pa.Table:
    """The few rows of df, computed as a step."""
    with as_step(df.sparkSession):
        return df.select("*").toArrow()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal for equal values, otherwise spread out."""
    x = x ^ (x >> _U(30))
    x = x * _MIX1
    x = x ^ (x >> _U(27))
    x = x * _MIX2
    return x ^ (x >> _U(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; kept for the next call."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))))
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts: their 64-bit hashes (A-Z as a-z), places in the joined bytes, and each text's share."""

    def __init__(self, texts: list[str | None], kind: np.ndarray):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        inside = kind[self.buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
        self.bounds = np.searchsorted(self.starts, self.text_starts)
        power, inverse = _powers(len(self.buffer) + 1)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.buffer] * power[: len(self.buffer)])))
        self.hashes = mix((prefix[self.ends] - prefix[self.starts]) * inverse[self.starts])
        self.counts = np.diff(self.bounds)


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; a longer text makes a range of its own."""
    begun = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begun and size + n > most:
            yield begun, i
            begun, size = i, 0
        size += n
    if begun < len(texts):
        yield begun, len(texts)
