"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; none of them depends on the cluster's size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole texts go to the Python workers by bytes, not by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("cuegrid")
               .config("spark.sql.shuffle.partitions", str(cores))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               # building column expressions is several times faster without call sites
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def prepared(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that first fits a session somebody else has made: settings, and the code itself,
    which Python workers on other machines have to import."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(configure(spark))
        return make(spark, folder)

    return run


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_cuegrid_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cuegrid-code-"), "cuegrid_code.zip")  # Spark's own file server hands it out
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
        pipeline = root.parent / "corpus_pipeline.py"
        if pipeline.exists():
            bundle.write(pipeline, pipeline.name)
    context.addPyFile(str(target))
    context._cuegrid_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share. Only a session on
    one machine may leave that unset (tests); it then gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cuegrid-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back, so that later stages (and
    recomputation after a lost executor) start from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet into the shared folder and read from there. Unlike a checkpoint it keeps
    its size, by which Spark decides what to broadcast, and gives only the columns asked for. The
    files (``stored-*``) may go once the query's result is kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
