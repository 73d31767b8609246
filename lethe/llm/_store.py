"""Shared storage, lineage cuts and column hygiene for the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column; input columns that start with it are dropped.
OWN = "__lethe_"
_PATH = "_lethe_path"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, with its file system.

    One is set only where none is: a temporary folder if Spark runs in one process, else one below the home of the default
    file system, which must not be local to a machine.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = conf or spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    jsc, jvm = sc._jsc.sc(), sc._jvm
    if found is None and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if found is None:
        if jsc.isLocal():
            found = "file://" + os.path.join(tempfile.gettempdir(), "lethe-checkpoints")
        else:
            fs = jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
            if fs.getScheme() == "file":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = fs.getHomeDirectory().toString() + "/lethe-checkpoints"
    if not jsc.getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    path = jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Paths made in each open scope.
_open: list[list[str]] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/lethe-{what}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that were stored in it, but for those given to the function it yields."""
    kept: set[str] = set()
    _open.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, _PATH))
        return df

    try:
        yield keep
    finally:
        made = _open.pop()
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif _open:
                _open[-1].append(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that are not read any more; what is not a stored table is passed over."""
    for df in tables:
        if (path := getattr(df, _PATH, None)) is not None:
            delete(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """Go on from a copy of df in the shared folder, without its lineage.

    A table rather than a checkpoint: it is computed once, and its size tells the planner which joins need no shuffle.
    """
    return stored(df, "cut")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, what)
    # The table is whole when the write returns, so what was shuffled for it is not needed any more.
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path in this process's cluster of one, else by an archive sent to them."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = sc.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if not sc._jsc.sc().isLocal() and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        to = os.path.join(tempfile.mkdtemp(), "lethe_llm.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder in ("lethe", "lethe/llm"):
                for name in sorted(os.listdir(os.path.join(root, folder))):
                    if name.endswith(".py"):
                        z.write(os.path.join(root, folder, name), f"{folder}/{name}")
        sc.addPyFile(to)


def clear(df: DataFrame, made: Iterable[str]) -> DataFrame:
    """df without columns that clash with those an operator makes, whatever their case."""
    taken = {c.lower() for c in made}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken and not c.startswith(OWN)])


def column(df: DataFrame, name: str, kind: str) -> Column:
    """df's column as kind, or null if there is none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
