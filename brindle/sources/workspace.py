"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid


def workspace(spark, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, in a local session (tests) under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"
