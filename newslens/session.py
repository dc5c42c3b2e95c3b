"""Session settings the results depend on, and the folder for intermediate files."""

import re
import uuid


def use_utc(spark):
    """Event days are UTC midnights, so the session must not shift them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# HotSpot only compiles methods of up to this many bytes.
COMPILED_METHOD = 8000


def use_compiled_methods(spark):
    """Generated code of wide rows in methods that the JVM compiles.

    Spark puts a stage over the 61 feed columns into one method, which the JVM then interprets on
    every row; beyond this limit Spark splits it by expression instead.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(limit, min(COMPILED_METHOD, int(spark.conf.get(limit))))
    return spark


def scratch_root(spark):
    """A part for each application of the shared folder that `spark.checkpoint.dir` names.

    Where that is unset, a session in one process uses its warehouse. On a cluster it has to be
    set: the warehouse's default is a folder of the driver's machine, which executors do not see.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/newslens/{spark.sparkContext.applicationId}"


def scratch_path(spark, name):
    """A fresh path for files that one Spark job writes and a later one reads."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark):
    """Delete this application's intermediate files, once none of its results is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
