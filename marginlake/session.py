"""Spark session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

from marginlake.functions.identity import SALT_CONF

# Settings every job here relies on. Shuffle partition count is left to the
# cluster (AQE coalesces it); nothing below depends on the machine size.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ids kept for de-duplication can outgrow the heap: keep streaming state on disk.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "marginlake", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the defaults above; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    hidden = {"spark.redaction.regex": "(?i)secret|password|token|access[.]?key|salt"}
    if SALT_CONF in conf:  # the salt is a literal of plans: keep it out of their text
        hidden["spark.sql.redaction.string.regex"] = f"\\Q_{conf[SALT_CONF]}\\E"
    for key, value in {**DEFAULTS, **hidden, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@cache
def _local_base() -> str:
    base = tempfile.mkdtemp(prefix="marginlake-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without that setting: it then gets a
    temporary folder, which on a cluster would exist on one machine alone. All of
    a process's temporary folders lie in one, removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
