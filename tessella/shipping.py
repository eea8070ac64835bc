"""Make this package importable by Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch. Whole documents pass through these batches, and both the JVM and the
#: Python worker hold some of them, so they are kept well below Spark's default of 10,000 rows.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, against very long documents.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(setting: str) -> int:
    """A size setting in bytes; one that can't be read, or is not positive, counts as no bound."""
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    number = setting.strip().lower()
    unit = number.lstrip("-0123456789").strip()
    try:
        size = int(number[: len(number) - len(unit)] if unit else number) << units.get(unit, 0)
    except ValueError:
        return BATCH_BYTES
    return size if size > 0 else BATCH_BYTES


def ship(spark: SparkSession) -> None:
    """Send the package's source files to the executors, once for each application, and bound Arrow batches.

    The bounds are settings of the session, so they hold for the caller's own Arrow functions too; smaller ones stay as they are.
    """
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    spark.conf.set(_BYTES_SETTING, f"{min(BATCH_BYTES, _bytes(spark.conf.get(_BYTES_SETTING)))}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="tessella-ship-"), "tessella_package.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)
