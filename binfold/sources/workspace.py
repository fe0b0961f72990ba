"""A folder for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.

    A local session without that setting gets a folder of its own, which goes when the driver
    ends; a session on other machines is an error, as each would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("executors on other machines need a folder that all share: set spark.checkpoint.dir")
    if app not in _own:
        made = tempfile.mkdtemp(prefix="binfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[app] = f"file://{made}"
    return _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
