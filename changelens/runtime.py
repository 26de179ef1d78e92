"""Session helpers: table access and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that Python stages can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="changelens-src-")) / "changelens.zip"  # served by the driver
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="changelens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/changelens-{spark.sparkContext.applicationId}"


def written(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` once computed: a table below ``spark.checkpoint.dir``, which all executors share, read again; in folders ``by``.

    Unlike a cached table it outlives lost executors, so what made it does not run a second time.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a whole: beside its place first, then over what is there by one rename."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    fresh = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, over)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it is read in fewer parts than there are: one small file, say."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
