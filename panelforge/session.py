"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings the plans rely on. They only steer the physical plan.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # chains of joins on one key keep skew handling at the price of a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "panelforge", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", **conf}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())


#: The folder of a local session without ``spark.checkpoint.dir``, which cannot be set while a session runs.
_OWN_DIR = "panelforge.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables, from ``spark.checkpoint.dir``.

    A session of one machine without the setting gets a temporary folder; a
    cluster session must name a folder that every executor can reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="panelforge-")
    spark.conf.set(_OWN_DIR, folder)
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession, packages: tuple[str, ...] = ("panelforge",)) -> None:
    """Sends the code of packages beside this one to the executors, once per application.

    Python workers import the functions they run; on a cluster they do not see the driver's folders.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="panelforge-code-"), "panelforge-code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for package in packages:
            for file in sorted((root / package).rglob("*.py")):
                out.write(file, file.relative_to(root))
    # the driver serves the file to the executors
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints (tree training, iterative plans) at the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
