"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in
    tests, a temporary folder that this session then keeps. On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            folder = jvm_dir.get()
        elif not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            folder = "file:" + tempfile.mkdtemp(prefix="weftline-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths written in the temporary() blocks that are open in this thread, innermost last.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("weftline_open", default=())


def _give_back(spark: SparkSession) -> None:
    """Hand free native memory of the driver back to the system.

    Compiling the code of plan after plan leaves the C heap full of holes,
    which glibc keeps; JDKs that can (17.0.9 and later, on Linux) trim it.
    """
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def stored(df: DataFrame, name: str, **counted: Column) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and read it again.

    The number of its rows (``n_rows``), and what else is to be ``counted`` in
    them, is told by the tasks that write, so no job has to read them for that.

    The result depends on files alone: a lost executor costs no earlier stage,
    and later readers prune columns and push filters down. The shuffle files of
    the plan that made it go as soon as the driver's collector sees that
    nothing refers to them, which a collection at this point brings about.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in counted.items()]).write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path, out.counted = path, seen.get
    out.n_rows = out.counted["n_rows"]
    if _open.get():
        _open.get()[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table from :func:`stored` that nothing reads any more."""
    _delete(df.sparkSession, df.scratch_path)
    for paths in _open.get():
        if df.scratch_path in paths:
            paths.remove(df.scratch_path)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Delete the tables that the block stores, but for those given to the function it yields."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    outer = _open.get()
    _open.set((*outer, paths))
    try:
        yield keep
    finally:
        _open.set(outer)
        for path in paths:
            if path not in kept:
                _delete(spark, path)
            elif outer:
                outer[-1].append(path)
