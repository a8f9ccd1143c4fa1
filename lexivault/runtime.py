"""Getting this package to the executors, and the folder that they share with the driver."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults: batches of whole texts at 10,000 rows take
#: hundreds of megabytes of each task, on both sides of the pipe.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, once a Spark context, and gives the session back. A cluster's
    executors needn't have it installed: they fetch an archive of its sources from the driver. Arrow batches become those
    of ``BATCHES`` unless the session has set its own."""
    context = spark.sparkContext
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    if getattr(ship, "done", None) != context.applicationId:
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lexivault-ship-")) / "lexivault-sources.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        context.addPyFile(str(archive))
        ship.done = context.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where unset (tests), one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lexivault-shared-")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs
    no recomputation of what stands above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
