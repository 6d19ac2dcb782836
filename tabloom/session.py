"""Sessions, and the package itself for executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}
_own: list[str] = []


def session(app: str = "tabloom", **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rest on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files once, so Python workers on any executor can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="tabloom-", suffix=".zip")
    with os.fdopen(fd, "wb") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, f"{top.name}/{path.relative_to(top)}")
    context.addPyFile(name)
    _shipped[context.applicationId] = name


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``; where that is unset, a folder of this process, which only a
    session on this machine alone can use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tabloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = f"file://{_own[0]}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and cut from its lineage: nothing is lost with an executor, and the plan of
    what follows starts anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
