"""Session set-up, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver was started from, if it lies at the same place there."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if repo_root() not in paths:
        env["PYTHONPATH"] = os.pathsep.join([repo_root(), *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a parquet file or a folder of parts."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir. Only where that is unset and all work
    is done in one process (tests, one machine) a temporary folder is made, remembered in the session and removed at exit;
    on a cluster it is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.verdigris.shared.dir", None)
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="verdigris-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        got = "file://" + path
        spark.conf.set("spark.verdigris.shared.dir", got)
    return got.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own folder within the shared one, which goes when the program ends."""
    path = f"{shared_dir(spark)}/verdigris-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_at_exit, spark)
    return path


def _at_exit(spark: SparkSession) -> None:
    try:
        forget(spark)
    except Exception:  # the JVM is gone, and nothing can be done about it here
        pass


_folders: set[str] = set()


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this session stored; tables read from them are gone as well. Done at exit, if the session is
    still running then; a long-lived session calls it between jobs."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{shared_dir(spark)}/verdigris-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, the step is computed once,
    and a lost executor costs nothing but the running tasks. Unlike a checkpoint the table is compressed, columnar and
    carries the statistics from which the planner picks join strategies. It stays until the session ends or forgets it."""
    spark = df.sparkSession
    importable(spark)
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes of a plan below which nothing is known of the partitions.
_MOVES = re.compile(r"^[\s:+\-]*(?:Join|Aggregate|Sort|Window|Distinct|Repartition|Rebalance)", re.M)


def spread(df: DataFrame) -> DataFrame:
    """A scan whose few files would keep most cores idle, dealt to all of them; for steps that cost far more than moving
    their rows. Scans with enough splits are left as they are, so at scale nothing is moved; so is what isn't a mere scan,
    whose partitions can't be told without running it."""
    importable(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if _MOVES.search(plan.toString()):
        return df
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
