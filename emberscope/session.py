"""Session set-up and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "emberscope", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Recording the call site of every column expression doubles the time to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """All hour and date keys are taken in UTC, whatever the zone of the machine."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session without the setting falls back to a temporary folder;
    on a cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="emberscope-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder. Nothing is created on disk yet."""
    return f"{shared_root(spark)}/emberscope/{purpose}-{uuid.uuid4().hex}"


def materialize(df, purpose: str):
    """Write ``df`` to the shared folder and read it back, cutting the lineage.

    Used where a plan refers to one expensive intermediate several times. The
    written table survives the loss of any executor.
    """
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one job, removed as soon as nothing reads them any more.

    ``put`` writes a table and reads it back; ``clear`` removes all but the named ones. The results
    a caller gets stand in tables of their own.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[object, str]] = {}

    def put(self, df, purpose: str):
        path = fresh_dir(self.spark, purpose)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables) -> None:
        for table in tables:
            held = self._paths.pop(id(table), None)
            if held:
                remove_dir(self.spark, held[1])

    def clear(self, *but) -> None:
        keep = {id(t) for t in but}
        self.drop(*[t for k, (t, _) in self._paths.items() if k not in keep])
