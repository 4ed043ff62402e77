"""Session, table and scratch-folder helpers shared by every job."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks, with a scratch folder of this machine if none is set; cluster jobs bring their own."""
    build = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    session = build.getOrCreate()
    if session.conf.get("spark.checkpoint.dir", None) is None:  # it can't be set later
        session.stop()
        session = build.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lectern-")).getOrCreate()
    return session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names; without that setting there is no place to write to.

    :func:`local_session` sets a folder of this machine, which is right only where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
    return f"{root.rstrip('/')}/lectern-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, dealt: bool = False, ordered: bool = False) -> DataFrame:
    """As :func:`cut`, in buckets by ``key``: joins on it shuffle the other side only.

    ``dealt``: rows come from a join or aggregation by ``key``, which has them in their buckets' tasks already.
    ``ordered``: buckets are sorted by ``key``.
    """
    spark = df.sparkSession
    path, n = scratch(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"lectern_{uuid.uuid4().hex}"
    out = (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).option("path", path)
    (out.sortBy(key) if ordered else out).saveAsTable(known)
    out = spark.table(known)
    out._lectern_path, out._lectern_table = path, known
    return out


def forget(df: DataFrame) -> None:
    """Delete what :func:`cut` or :func:`bucketed` wrote, once nothing reads it any more; other frames are left alone."""
    if known := getattr(df, "_lectern_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {known}")
    if path := getattr(df, "_lectern_path", None):
        discard(df.sparkSession, path.rsplit("/", 1)[0])


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that hold a finished write, sorted; none if there is no such path."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    below = [f.getPath() for f in fs.listStatus(root) if f.isDirectory()]
    return sorted(p.getName() for p in below if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application; jobs with Python stages call it."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._lectern_shipped = True
