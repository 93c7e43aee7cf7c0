"""Tables of intermediate results in the folder that the driver and all executors share.

Long plans are cut here: a frame is written as Parquet and read back, so what follows starts from a table, and a lost
executor costs no more than the stages after it. Tables made inside `scope()` go when the scope ends, the others when
the application does.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

Tables = list[tuple[SparkSession, str]]
_application: Tables = []
#: The scopes that the present thread is in: a stream's batches have their own.
_scopes: ContextVar[tuple[Tables, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where none is set (single-machine sessions only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path, which goes with the scope that it was asked for in."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (_scopes.get() or (_application,))[-1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written and read back."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _remove(tables: Tables) -> None:
    for spark, path in tables:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scope() -> Iterator[None]:
    """Removes the tables made inside when it ends; what is still needed then has to be kept() by then."""
    mine: Tables = []
    before = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(before)
        _remove(mine)


def kept(df: DataFrame, name: str) -> DataFrame:
    """materialize() for the scope outside the present one: the result of what is done here."""
    before = _scopes.set(_scopes.get()[:-1])
    try:
        return materialize(df, name)
    finally:
        _scopes.reset(before)


@atexit.register
def _at_exit() -> None:
    try:
        _remove(_application)
    except Exception:  # noqa: BLE001  the session may be gone; then the shared folder's own clean-up has to do
        pass
