"""Session helpers: building a local session and resolving the shared
checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "precis") -> SparkSession:
    """Local session for tests and the bench.  On a cluster the caller's
    own session is used instead and none of this applies."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config(SCAN_TASKS, str(cores) if str(cores).isdigit() else "0")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is the shared folder the deployment configures; it is
    read from the session and never overridden.  Only when it is unset (local
    tests) a fresh scratch folder is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="precis-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # noqa: BLE001 - core conf not settable at runtime; the context dir below suffices
        pass
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: session setting: number of tasks over which a table is dealt after its scan
SCAN_TASKS = "spark.precis.scanTasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table of the folder.

    Small files with one row group are read by one task each, which leaves cores
    idle in work that never shuffles.  A session for such files (a local run) can
    set ``SCAN_TASKS`` to have every table dealt out in that many tasks; unset,
    the default, nothing is added to the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    tasks = int(spark.conf.get(SCAN_TASKS, "0"))
    return df.repartition(tasks) if tasks else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for tables a job
    writes and reads back (never a machine-local temp folder on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/precis-tables/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared checkpoint folder and return the written
    table, for steps that several consumers would evaluate again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
