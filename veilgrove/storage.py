"""Cutting lineage in iterative plans."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the folder that ``spark.checkpoint.dir`` names, which all executors share.

    A folder is made only where that setting is missing and executors are threads
    of this process, as in tests; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilgrove-checkpoint-"))
    return df.checkpoint()
