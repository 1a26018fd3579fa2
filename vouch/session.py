"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Arrow batches end by rows alone unless this is set; texts of a few kilobytes then make batches of tens of megabytes.
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

_shipped: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application, wherever the driver was started.

    Where the session sets no size for Arrow batches, it gets BATCH_BYTES.
    """
    if spark.conf.get(BATCH_BYTES_KEY, None) is None:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "vouch.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("vouch", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
