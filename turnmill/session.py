"""What a session needs before this library's Python functions can run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: The bytes of a batch that goes to Python, unless the session sets its own: an executor holds some for each core, and keeps
#: the memory of the largest. Batches of narrow rows end by their number of rows first.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, as ``--py-files`` would, and bounds its Arrow batches."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="turnmill-ship-")) / "turnmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    context.addPyFile(str(target.resolve()))
    _SHIPPED.add(context.applicationId)
