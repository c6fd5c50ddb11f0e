"""Sends the library to executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package, and the pipeline beside it if there is one, to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="kerbside-"), "kerbside.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "kerbside")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
        if os.path.exists(extra := os.path.join(root, "corpus_pipeline.py")):
            z.write(extra, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
