"""Session helpers that every layer shares: shipping the package, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_scratch: dict[str, str] = {}
_written: dict[int, tuple] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gridloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def give_back(spark: SparkSession) -> None:
    """Let the executors' JVMs collect garbage, after which they give free heap back to the system.

    Between stages whose Python workers take their memory beside a heap that earlier stages have grown.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="gridloom-scratch-")
        spark.sparkContext.setCheckpointDir(_own_scratch[app])
    return _own_scratch[app]


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet under the shared scratch folder, packed by codec, and read it back.

    This cuts the lineage: later reads depend on files that all executors see.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gridloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    _written[id(back)] = (weakref.ref(back), path)
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; call it when everything that reads them has been written."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
