"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "echoline") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def on_one_machine(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared by all."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir, or else the context's checkpoint directory.

    Where neither is set, a temporary folder does on one machine only; on a cluster it is an error, as every
    executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not on_one_machine(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    folder = getattr(spark, "_echoline_folder", None)
    if not folder:
        kept = tempfile.TemporaryDirectory(prefix="echoline-")
        atexit.register(kept.cleanup)
        folder = spark._echoline_folder = kept.name
    return folder


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a scan of few or small files would leave most of them idle.

    Meant for work that costs far more than moving the rows. A plan with shuffles, or one that has enough
    partitions already, as any large table has, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "AdaptiveSparkPlan" in plan or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Tables written and not removed yet: path -> session.
_WRITTEN: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _WRITTEN.pop(path, None)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Remove what materialize wrote in this session and nobody reads any more; call it once results are consumed."""
    _remove(spark, [p for p, s in list(_WRITTEN.items()) if s is spark and p not in keep])


def written(spark: SparkSession) -> set[str]:
    """The tables that are there now, for release to keep."""
    return {p for p, s in _WRITTEN.items() if s is spark}


@atexit.register
def _clean() -> None:
    """Remove what is left when the driver's Python ends."""
    try:
        for spark in set(_WRITTEN.values()):
            release(spark)
    except Exception:  # the JVM may be gone
        pass


class Scratch:
    """Tables that only the steps of one operator read; all are removed at its end.

    with Scratch() as scratch: a = scratch.write(df, "a"); ... ; result = materialize(...)
    """

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = _write(df, label)
        self.paths.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        for spark, path in self.paths:
            _remove(spark, [path])


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet; release removes what is written there."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def _write(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if on_one_machine(spark.sparkContext.master):
        df.write.parquet(path)
        return path
    # a folder that isn't shared after all would lose rows without a word
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    there = spark.read.schema(df.schema).parquet(path).count()
    if there != seen.get["rows"]:
        raise RuntimeError(f"{path} holds {there} of {seen.get['rows']} rows; it isn't shared by all executors")
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage and survives lost executors, as the files are not on any one of them. The table stays
    until release is called or the driver's Python ends, since the result may read it.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, label))
