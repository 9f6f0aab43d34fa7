"""Session settings and the shared folder used to cut lineage in iterative operators."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

#: Settings the operators rely on; all are Spark defaults except the time zone.
REQUIRED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_local_roots: dict[str, str] = {}
_shipped: set[tuple[str, str]] = set()


def local_session(app: str = "replyloom", cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession, *packages: str) -> None:
    """Send Python packages to the executors, whose workers import the helpers of the few Python functions.

    Not needed where the packages are installed on every node.
    """
    app = spark.sparkContext.applicationId
    for package in packages:
        if (app, package) not in _shipped:
            folder = os.path.dirname(os.path.abspath(importlib.import_module(package).__file__))
            base = os.path.join(tempfile.mkdtemp(prefix="ship-"), package)
            archive = shutil.make_archive(base, "zip", os.path.dirname(folder), package)
            spark.sparkContext.addPyFile(archive)
            _shipped.add((app, package))


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, since executors elsewhere could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="replyloom-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the application's own part of the scratch folder, which can go when it has ended."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/replyloom-{app}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: a cut lineage that survives lost executors.

    A written table is preferred to ``checkpoint()`` because the re-read is columnar and has a true size,
    so the optimizer can choose join strategies from it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class RoundTable:
    """A table that grows by one ``round=k`` folder per step of an iterative operator."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType, split: str | None = None):
        self.spark = spark
        self.path = scratch_path(spark, name)
        self.split = split
        self.schema = T.StructType(schema.fields + [T.StructField("round", T.IntegerType())])

    def append(self, df: DataFrame, round_no: int, **counters: Column) -> dict[str, int]:
        """Write one round; ``counters`` are aggregates taken while writing.

        A retried task may be counted twice, so use them only as bounds and for "is there any".
        """
        seen = Observation()
        writer = df.observe(seen, *[c.alias(n) for n, c in counters.items()]).write
        if self.split:
            writer = writer.partitionBy(self.split)
        writer.parquet(f"{self.path}/round={round_no}")
        return seen.get

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
