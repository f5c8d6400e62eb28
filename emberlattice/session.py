"""Session helpers: settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Skip recording a call site for every column expression: plans here hold hundreds of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "emberlattice", master: str | None = None, **conf) -> SparkSession:
    """Create (or fetch) a session with AQE and UTC set; extra settings via keyword pairs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="emberlattice-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage cut, run once, size known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Store the table once in the shared folder and cut its lineage (reliable checkpoint)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
