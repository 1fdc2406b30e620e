"""Spark session defaults and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for TIMESTAMP_NTZ, AQE for
# runtime re-planning (coalescing, skew splits, broadcast switch), no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",  # uuid lists reach the Bloom filters, see MessageStore.stored_uuids
    "spark.sql.variant.allowDuplicateKeys": "true",   # see validate.parse_lines
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "logscope",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass no master: the launcher sets it. ``shuffle_partitions``
    should be sized to the data (about 128-256 MB per shuffle partition).
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
    for k in ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode"):
        spark.conf.set(k, conf[k])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for local runs.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is always
    used. Only when it is unset *and* Spark runs in local mode (tests, a laptop)
    is a scratch folder created. On a cluster without the setting this fails
    rather than checkpointing to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master == "local" or sc.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="logscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
