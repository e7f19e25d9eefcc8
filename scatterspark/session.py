"""Session helpers shared by operators that iterate."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "scatterspark", cpus: str = "8", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. A session of one machine gets a folder of its own where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="scatterspark-ckpt-")
    sc.setCheckpointDir(folder)


@contextlib.contextmanager
def _freed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not at some later garbage collection of the driver."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with _freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as the setting counts when a plan is made


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again: compressed, and read by column."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/saved-{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved = path
    return out


_scratch: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what ``saved`` returned, where nothing reads it any more."""
    for x in tables:
        _delete(x.sparkSession, x._saved)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables saved inside are deleted at the end: what leaves must not read them any more, so it has to be cut first."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)
