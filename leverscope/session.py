"""What the library needs from the session it is handed; it never makes its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from leverscope.errors import AnalysisError


def checkpoint_dir(spark: SparkSession, required: bool = True) -> str | None:
    """The shared folder for checkpoints, as the cluster names it.

    Only a ``local`` session without the setting gets a folder of its own: there
    driver and executors are one machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="leverscope-checkpoint-"))
        elif required:
            raise AnalysisError(
                "checkpointDirMissing",
                "Set spark.checkpoint.dir to a folder every executor can reach.",
            )
    return configured or context.getCheckpointDir()
