"""Session helpers: table loading, shared scratch space, code shipping."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FILES_PER_CORE = 4
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glossa")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` below `sf_dir`; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "glossa_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a
    temporary folder in local mode, else a folder below the warehouse."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        where = "file://" + tempfile.mkdtemp(prefix="glossa-")
    else:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` to the shared scratch folder and read it back: lineage is cut
    and any executor can read the rows again. Returns the frame and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    few_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def few_files(df: DataFrame) -> DataFrame:
    """`df` in at most FILES_PER_CORE partitions for each core: a table of many
    small files costs more in making and listing them than in rows. Partitions
    are read one after the other by a task, so that none needs more memory."""
    return df.coalesce(FILES_PER_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism))


#: Partitions for each core that costly row-local work is spread over.
SPREAD = 3


def spread(df: DataFrame) -> DataFrame:
    """`df` in SPREAD partitions for each core at least. A table may lie in few
    files or row groups, whose rows would all go to few tasks."""
    if df.isStreaming:
        return df
    n = SPREAD * max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that went out of scope. It
    learns of them when the driver collects garbage, which this asks for."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
