"""Session helpers shared by every operator: table access, lineage cuts on shared storage, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a table may be broadcast by :func:`small`; larger tables are joined by shuffle.
BROADCAST_ROWS = 10_000

_own_scratch: list[str] = []
_written: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that functions sent to them can be unpickled anywhere."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="linkloom-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/linkloom", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A private folder of this machine serves only where that is unset and all of Spark is one process; a cluster without it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="linkloom-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return _own_scratch[0]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path on the shared scratch storage, deleted by :func:`scratch_scope` or when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(since: int = 0) -> None:
    """Removes what was written from place ``since`` of the list on; what can't be removed stays."""
    paths, _written[since:] = _written[since:], []
    jvm = SparkContext._jvm
    for path in paths:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
        except Exception:  # noqa: BLE001, S110
            pass


atexit.register(_delete)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes on leaving what was written inside; results that still read it must have been written or collected."""
    before = len(_written)
    try:
        yield
    finally:
        _delete(before)


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage: what follows survives the loss of executors without recomputing ``df``, and the
    columnar copy keeps column pruning and filter pushdown for its readers.
    """
    path = fresh(df.sparkSession, "linkloom")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to hold at most ``rows`` rows, else unchanged.

    The check reads at most ``rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
