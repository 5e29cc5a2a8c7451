"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir.

    Where that is unset, a temporary one of this process, removed at its end;
    on a cluster, whose machines would each see their own, an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="ledgerlink-model-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        base = "file://" + _local["dir"]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
