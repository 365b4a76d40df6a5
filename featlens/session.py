"""Session helpers: a tuned local session for tests/bench and a checkpoint-dir guard.

On a cluster the session is created by the platform; we only read its settings.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``spread``: rows that make another task worth it, and rows that one task has at most.
LEAST_ROWS, MOST_ROWS = 100_000, 2_000_000
#: Spark's setting for shuffle files to go when the query that wrote them has ended (Spark 4.1; unknown to older ones, which pass over it).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # methods above 8000 bytes of bytecode are never compiled by the JVM: let such stages run as separate operators
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g", app: str = "featlens") -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring ``spark.checkpoint.dir``.

    A cluster must name a shared folder in ``spark.checkpoint.dir``; only a local
    master (tests, the bench) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="featlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder (HDFS/S3/ABFS) for checkpoints")


class OwnedTables:
    """The tables that ``materialize`` wrote inside one ``owned_tables`` block."""

    def __init__(self, spark: SparkSession, outer: OwnedTables | None):
        self.spark, self.outer = spark, outer
        self.paths: list[str] = []
        self._plans: dict[int, list] = {}   # hash of a plan -> [(frame, the table it was written to)]

    def written(self, df: DataFrame) -> DataFrame | None:
        """The table of a frame with the same plan, if this block or one around it has it."""
        for plan, table in self._plans.get(df.semanticHash(), ()):
            if plan.sameSemantics(df):
                return table
        return self.outer.written(df) if self.outer else None

    def add(self, df: DataFrame, table: DataFrame) -> None:
        self._plans.setdefault(df.semanticHash(), []).append((df, table))

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that outlives this block: it belongs to the block around it, or to nobody."""
        token = _OWNER.set(self.outer)
        try:
            return materialize(df)
        finally:
            _OWNER.reset(token)

    def release(self) -> None:
        """Removes the tables from the shared folder (also one whose write failed)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        self._plans.clear()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


_OWNER: ContextVar[OwnedTables | None] = ContextVar("owned_tables", default=None)


@contextmanager
def owned_tables(spark: SparkSession):
    """Intermediate tables written inside the block are removed at its end, whether it ends well or not.

    Frames are lazy: what is to outlive the block has to be written inside it, by a sink or with ``keep``. Frames
    with equal plans are written once. A plan says where it reads, not what lies there, so don't overwrite a
    path and read it again inside one block. Blocks nest; each owns what was written while it was the innermost.
    """
    owner = OwnedTables(spark, _OWNER.get())
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)
        owner.release()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with ``values`` inside the block, as they were behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table under ``spark.checkpoint.dir`` (the
    shared folder) and reading it back: survives executor loss, is columnar (faster than
    ``Dataset.checkpoint``'s row serialisation), and lets several branches share one result.
    The shuffle files of the write go with it, not when the driver happens to collect its garbage: nothing
    reads them again. ``batch_rows``: rows that Python functions of the plan get at once, for rows of many bytes.

    Inside ``owned_tables`` the table is removed at the block's end, else it stays."""
    spark = df.sparkSession
    owner = _OWNER.get()
    found = owner.written(df) if owner else None
    if found is not None:
        return found
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/featlens-{uuid.uuid4().hex}"
    if owner:
        owner.paths.append(path)
    rows = {} if batch_rows is None else {ARROW_ROWS: str(batch_rows)}
    with _settings(spark, {SHUFFLES_GO: "true"} | rows):
        df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    if owner:
        owner.add(df, table)
    return table


def held_table(df: DataFrame):
    """``df`` written as by ``materialize``, and what removes the table: for steps that replace one another's tables."""
    owner = OwnedTables(df.sparkSession, None)
    token = _OWNER.set(owner)
    try:
        return materialize(df), owner.release
    except BaseException:
        owner.release()
        raise
    finally:
        _OWNER.reset(token)


def spread(df: DataFrame, least: int = LEAST_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """``df`` dealt out evenly if a few tasks hold most of its rows, as with a table in one file or row group.

    A task for every core where each gets ``least`` rows, more where one would get over ``most``; a table that
    lies evenly, or is small, stays as it is. Counts the rows of ``df`` by task: meant for scans of written tables."""
    of = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    rows, largest = of.agg(F.sum("_n"), F.max("_n")).first()
    tasks = min((rows or 0) // least, max(df.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // most)))
    return df.repartition(tasks) if tasks > 1 and largest * tasks >= 2 * rows else df
