"""Session settings and the two places where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results or the skew handling rely on. All are runtime SQL settings.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split hot key is worth an extra exchange after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Static settings, given only when this module starts the session. Plans here are built from many
# small expressions; call-site capture doubles their cost.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build(app: str = "casetrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    # getCheckpointDir is the per-application folder below the configured one.
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="casetrail-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


ROWS_A_TASK = 100_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df dealt to all shuffle partitions: for rows of few bytes that cost much work, which file splits and adaptive
    coalescing would leave to one task. A given number of partitions is not coalesced; with `rows`, the size of df, there
    are more of them where one would hold over ROWS_A_TASK."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_TASK), *keys)


_folders: list[str] = []   # of the open `stages` scopes, innermost last


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and go on from the written copy.

    The rows are computed once, and the copy has size statistics. Inside `stages` the copy lasts as long as the scope.
    """
    spark = df.sparkSession
    path = f"{_folders[-1]}/{uuid.uuid4().hex}" if _folders else scratch(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def removed(*tables: DataFrame) -> None:
    """Delete the written tables behind these DataFrames; for scratch tables that no later plan reads."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            _delete(df.sparkSession, path)


@contextmanager
def stages(spark: SparkSession):
    """Copies written by `cut` inside are removed at the end: for work whose results were stored, as a micro-batch's."""
    path = scratch(spark, "stages")
    _folders.append(path)
    try:
        yield
    finally:
        _folders.remove(path)
        _delete(spark, path)
