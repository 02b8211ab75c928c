"""Helpers that several operators share: table access, lineage cuts and expression binding."""

from __future__ import annotations

import ctypes
import tempfile
import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that splits words in every contract of this subpackage.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder comes from spark.checkpoint.dir; one of our own only where that is unset and all runs in this process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-checkpoints-"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For the cuts under way, in whatever thread: how many hold a setting, and what it was before the first of them.
_held: dict[str, tuple[int, str | None]] = {}
_lock = threading.Lock()


def cut(df: DataFrame, share: int = 1, settings: dict[str, str] | None = None) -> DataFrame:
    """Reliable checkpoint: later stages restart from shared storage after an executor is lost.

    share: df is at most so small a part of what the shuffle partitions are made for, and gets as many fewer files.
    settings: of the session, for df's work alone.

    The shuffle files behind it are deleted once it is written, as nothing reads them again. The session's settings
    are put back when the last of the cuts under way that hold them has ended.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if share > 1:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // share))
    settings = {_CLEANUP: "true"} | (settings or {})
    with _lock:
        for name, value in settings.items():
            n, before = _held.get(name) or (0, spark.conf.get(name, None))
            _held[name] = n + 1, before
            spark.conf.set(name, value)
    try:
        # a new DataFrame of the same plan, so that the settings hold for this action alone
        return df.select("*").checkpoint(eager=True)
    finally:
        with _lock:
            for name in settings:
                n, before = _held.pop(name)
                if n > 1:
                    _held[name] = n - 1, before
                elif before is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, before)


def hidden(docs: DataFrame, *names: str) -> DataFrame:
    """docs with all columns but the named ones renamed, so that an operator's own columns can't clash with them.

    Rows come back as they were by ``out.select(*hidden.columns).toDF(*docs.columns)``.
    """
    return docs.toDF(*[c if c in names else f"_own{k}" for k, c in enumerate(docs.columns)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, whatever the optimizer collapses."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """In a Python worker, between blocks of work: hands freed memory back, as the worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
