"""Session factory, package shipping and durable intermediate tables."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_DIRS: list[str] = []


def get_session(app: str = "tessella", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir. Where that is unset, a session on one machine (tests, the
    bench) gets a folder of its own; a cluster is refused, as its executors can't read each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL_DIRS:
            _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="tessella-ckpt-"))
            atexit.register(lambda: [shutil.rmtree(d, ignore_errors=True) for d in _LOCAL_DIRS])
        base = _LOCAL_DIRS[0]
    return f"{base.rstrip('/')}/tessella/{spark.sparkContext.applicationId}"


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application, so Python workers can import it.

    The archive lies in the shared folder, as executors that start later fetch it, too."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    archive = f"{shared_dir(spark)}/tessella_src.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(archive)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    w = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Remove this application's intermediate tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _SHIPPED.discard(spark.sparkContext.applicationId)
