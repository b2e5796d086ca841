"""Session helpers."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    sources = [(str(p.relative_to(package.parent)), p.read_bytes()) for p in sorted(package.rglob("*.py"))]
    digest = hashlib.sha256(repr(sources).encode()).hexdigest()[:16]
    archive = os.path.join(tempfile.gettempdir(), f"tessera-{digest}.zip")
    if not os.path.exists(archive):
        with zipfile.ZipFile(f"{archive}.{os.getpid()}", "w") as z:
            for name, content in sources:
                z.writestr(zipfile.ZipInfo(name), content)
        os.replace(f"{archive}.{os.getpid()}", archive)
    context.addPyFile(archive)
    context._tessera_shipped = True
    return spark
