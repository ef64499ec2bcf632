"""Reliable checkpoints in the folder that the session names, and their end."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of ``spark.checkpoint.dir``, so that lost executors cost little.

    Without that setting a session of one JVM (as in tests) gets a folder of its own. On a cluster it is an error: no
    folder is known to be shared there.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpointed frames that nothing reads any more, and let go of what their plans broadcast.

    Spark's cleaner frees broadcasts and shuffles once the driver has collected what named them. Left to chance, a loop
    of joins would fill the executors with the tables of all its steps, of a memory page each, however small.
    """
    for df in frames:
        spark = df.sparkSession
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            file = leaf.rdd().getCheckpointFile() if leaf.getClass().getSimpleName() == "LogicalRDD" else None
            if file and file.isDefined():
                path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()
