"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  The session time zone is
# pinned to UTC because event times are naive UTC and calendar features
# (hour, weekday) must not shift with the cluster's locale.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files of frames no longer referenced are removed, so a
    # long-running session does not fill the shared checkpoint folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               target_partition_bytes: int = 1 << 30, shuffle_fraction: float = 0.5,
               max_partitions: int = 100_000, scan_split_bytes: int = 512 << 20) -> dict:
    """Partition sizing for a cluster run (spill-aware defaults).

    Initial shuffle partitions are sized so one partition of the largest
    shuffle (~``shuffle_fraction`` of the input after column pruning) is about
    ``target_partition_bytes``, rounded up to whole waves of task slots and
    capped (map-status metadata on the driver grows with maps x reducers).
    AQE then coalesces small partitions towards a quarter of the target and
    splits skewed ones at run time.  Scan splits of ``scan_split_bytes`` keep a
    task's input well inside executor memory.
    """
    slots = max(1, executors * cores_per_executor)
    wanted = max(slots, int(input_bytes * shuffle_fraction) // target_partition_bytes + 1)
    partitions = min(-(-wanted // slots) * slots, max(max_partitions, slots))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 4),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def build_session(master: str | None = None, app: str = "vigil",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster leave ``master`` unset so spark-submit decides; tests and the
    bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Jobs handed a foreign session still need UTC calendar semantics."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory the cluster names.

    The cluster's ``spark.checkpoint.dir`` (a shared filesystem) always wins.
    Only a local-mode session without one (tests, the bench) gets a fresh
    scratch directory; on a cluster a missing setting is an error, because a
    machine-local folder would not survive losing that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must be set on the Spark Connect server")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("VIGIL_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for job outputs
    (stream sinks, model artifacts, materialised tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    parent = base.rsplit("/", 1)[0] if "/" in base else base
    return f"{parent}/vigil-{name}-{uuid.uuid4().hex}"
