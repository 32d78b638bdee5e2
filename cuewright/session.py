"""Sessions and the shared folder for lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cuewright") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame, sized: bool = True) -> DataFrame:
    """Materialise df once in the cluster's shared checkpoint folder and cut its lineage.

    A checkpoint keeps the optimizer's estimate of its size. Every join multiplies those of its sides, so where each of many cuts is joined
    with what comes of it they get millions of digits, which cost the driver time and memory; sized=False leaves the estimate behind.

    The folder named in spark.checkpoint.dir is used as it is; only where none is set
    (tests, one machine) a folder of this machine takes its place.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"cuewright-{os.getpid()}")
        sc.setCheckpointDir(folder)
    done = df.checkpoint(eager=True)
    if sized:
        return done
    bare = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return type(done)(bare, spark)


def ship(spark: SparkSession) -> None:
    """Makes sure Python workers can import this package: sends it along unless they find it by PYTHONPATH or folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in seen or os.path.abspath(os.getcwd()) == root or getattr(sc, "_cuewright_shipped", False):
        return
    import shutil

    folder = tempfile.mkdtemp(prefix="cuewright-code-")  # of the driver; Spark's file server hands it to executors
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "cuewright"), "zip", root, "cuewright"))
    sc._cuewright_shipped = True
