"""Tables between the steps of a long plan."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

#: Where the session names no shared folder: one machine, tests.
LOCAL = "/tmp/gridloom-scratch"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read back.

    The plan behind it ends here, so later steps neither repeat nor re-plan it,
    and lost executors take nothing away.  Files go when the session's JVM ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(base or LOCAL).rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
