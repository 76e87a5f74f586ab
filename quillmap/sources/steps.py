"""Steps of a plan that are run once and go on from files that all machines see."""

from __future__ import annotations

import gc
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each Spark context, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmap_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quillmap-code-")) / "quillmap-code.zip"  # on the driver alone
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))
    sc._quillmap_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: the session's `spark.checkpoint.dir`. Where that is unset,
    a session on one machine gets a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_quillmap_folder"):
        sc._quillmap_folder = tempfile.mkdtemp(prefix="quillmap-checkpoint-")
    return sc._quillmap_folder


def cut(df: DataFrame, again: bool = False) -> DataFrame:
    """Run `df` once and go on from files in the shared checkpoint folder. again: what comes of it is
    joined and cut in a loop; the planner's guess at its size, a product over the joins before, is
    dropped then, since guesses that are multiplied in each round get millions of digits. With
    `spark.cleaner.referenceTracking.cleanCheckpoints` they go when nothing refers to them any more;
    without it they stay until the folder is deleted."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if again:
        spark = df.sparkSession
        out = DataFrame(spark._jsparkSession.createDataFrame(out._jdf.javaRDD(), out._jdf.schema()), spark)
    # Spark finds out what nothing refers to when the driver's JVM collects its garbage; without work
    # on the driver that would be never, and all steps' shuffle files would add up.
    gc.collect()
    sc._jvm.System.gc()
    return out
