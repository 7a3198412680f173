"""Session helpers shared by scripts and tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_temporary: dict[str, str] = {}  # scratch folders of local applications


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where all tasks run here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, _temporary[app], ignore_errors=True)
    return _temporary[app]


def cut(df: DataFrame) -> DataFrame:
    """The frame without its lineage, as a table in the shared checkpoint folder.

    A written table, not ``DataFrame.checkpoint``: that keeps the sort orders of its plan,
    whose equivalences multiply from one loop step to the next.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame) -> DataFrame:
    """The frame, never sent whole to all tasks by a join.

    Ids and labels shrink so much in a written table that Spark takes millions of its rows for
    little and broadcasts them through the driver.
    """
    return df.hint("merge")
