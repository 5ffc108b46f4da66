"""Session, scratch storage and skew helpers that every operator shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it has at least this share of all rows, so there are at most 1 / HOT_SHARE hot keys and a table of them may be broadcast.
HOT_SHARE = 1e-4

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []
_shipped: set[str] = set()


def session(cores: int | str = "*", partitions: int = 8, app: str = "kinweave") -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local runs, where that is unset, a temporary one of this process. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="kinweave-"))
            _written.append((spark, _own[0]))
        at = _own[0]
    return at.rstrip("/")


def temporary(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, to be deleted at exit."""
    at = f"{scratch_dir(spark)}/kinweave-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark, at = df.sparkSession, temporary(df.sparkSession)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_materialized() -> None:
    """Delete what materialize() wrote; runs at exit as well."""
    _own.clear()
    while _written:
        spark, at = _written.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001, S110  the JVM may be gone by then
            pass


atexit.register(drop_materialized)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python finds it wherever the driver's was loaded from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="kinweave-code-")) / "kinweave_code.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"{here.name}/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(stored: DataFrame) -> DataFrame:
    """A stored table (as from materialize()) in at least as many partitions as there are cores, for stages that run much Python."""
    n = parallelism(stored.sparkSession)
    return stored if stored.rdd.getNumPartitions() >= n else stored.repartition(n)


def hot_keys(df: DataFrame, key: str, least: int = 10_000, share: float = HOT_SHARE) -> DataFrame:
    """Keys with at least `least` rows and the share `share` of all rows, with their count as `hot_n`: at most 1 / share rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("hot_n"))
    total = df.agg(F.count("*").alias("all_n"))
    hot = counts.where(F.col("hot_n") >= least).crossJoin(F.broadcast(total))
    return hot.where(F.col("hot_n") >= F.col("all_n") * F.lit(share)).select(key, "hot_n")


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join `big` with `small`, which has one row a key, without sending a hot key's rows to one task.

    Rows of hot keys meet a broadcast of just those keys' rows (at most 1 / HOT_SHARE of them); all other rows are shuffled.
    `how` is "inner" or "left". Null keys never match.
    """
    hot = (hot_keys(big, key) if hot is None else hot).select(key)
    few = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    direct = big.join(few, key)
    rest = big.join(F.broadcast(small.select(key).join(F.broadcast(hot), key, "left_semi")), key, "left_anti").join(small, key, how)
    return direct.unionByName(rest)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with its rows' places from 0 in the order of the columns, in one distributed sort: a row's place in its partition and the sizes of those before."""
    place, part = F.col("__place"), F.shiftright("__place", 33)
    stored = materialize(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = stored.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(name, F.col("__start") + place.bitwiseAND(F.lit(2**33 - 1))).select(*df.columns, name)


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row a key, of deliveries that repeat: the least of the named columns taken together. Rows without a key are left out."""
    kept = F.min(F.struct(*columns)).alias("__kept")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(kept).select(key, *[F.col("__kept")[c].alias(c) for c in columns])


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
