"""Session options and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Options the jobs are written for.  All of them are ordinary Spark settings; the
# operators give the same rows without them.
SESSION_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookup joins carry no hint: below the threshold Spark broadcasts, above it
    # they run as shuffled joins whose hot partitions are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    # The JVM never compiles a method of more than 8,000 bytes to machine code.
    # Ingest steps whose generated code is larger run operator by operator
    # instead, which about halves their time.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Do not record the Python call site of every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_local_base: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master, as in
    tests, may do without that setting; it then gets one temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="trapline-")
        _local_base[context.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
