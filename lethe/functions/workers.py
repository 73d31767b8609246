"""Lets Python workers import this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Name the package's folder to workers of this machine, and send workers of others an archive of it."""
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if sc._jsc.sc().isLocal() or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    to = os.path.join(tempfile.mkdtemp(), "lethe_engine.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder in ("lethe", *(f"lethe/{x}" for x in ("functions", "operators", "plans", "sources", "streaming"))):
            for name in sorted(os.listdir(os.path.join(root, folder))):
                if name.endswith(".py"):
                    z.write(os.path.join(root, folder, name), f"{folder}/{name}")
    sc.addPyFile(to)
