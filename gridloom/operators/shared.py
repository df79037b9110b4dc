"""What operators keep for themselves in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read by all that follows: a reliable checkpoint in ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own serves if all runs in one process (local tests); else it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*)?", sc.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
