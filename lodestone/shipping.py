"""Bring the package to the executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import lodestone


def ship(spark: SparkSession) -> None:
    """Send the package's modules to every Python worker of the session, once.

    Workers look modules up by name, and have neither the driver's path nor, on a cluster, its
    files. The driver serves the archive to the executors itself, so no folder need be shared. Call
    it before a function of the package is put into a plan; the registered queries do.
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.abspath(lodestone.__file__))
    if getattr(sc, "_lodestone_shipped", False) or not os.path.isdir(home):
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodestone-")), "lodestone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._lodestone_shipped = True
