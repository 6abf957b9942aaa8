"""Session settings and the one way this library cuts lineage."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "issueloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a folder inside the warehouse, if every task can reach that: on a
    local master, or when the warehouse is not on a machine's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    if not alone and (warehouse.startswith("file:") or ":/" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_issueloom"


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/issueloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result has a one-node plan, survives the loss of any executor, is computed once,
    and carries true file sizes, so later joins broadcast only what is known to be small.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    # zstd works in streams; the default codec holds direct buffers outside the heap until a garbage collection comes by
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application. Call it when nothing that was derived is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
