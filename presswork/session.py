"""Session defaults and the staging of intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intermediate tables written by this process, removed by ``release`` or at exit.
_STAGED: list[tuple[SparkSession, str]] = []


def build_session(app: str = "presswork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; cluster settings win where already given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = b.config(map=base | conf).getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where it is unset
    (tests on one machine) is a local one chosen."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"presswork-{os.getpid()}")
    return at


#: Applications that have the package on their workers.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's modules to the executors' Python workers, once per application: they
    needn't find it where the driver does."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).parent
    tmp = tempfile.mkdtemp(prefix="presswork")  # on the driver only, which serves it
    atexit.register(shutil.rmtree, tmp, True)
    at = Path(tmp, "presswork_modules.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name, f.relative_to(root))))
    spark.sparkContext.addPyFile(str(at))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the result survives
    the loss of executors, and the planner knows its size."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    tidy(spark)
    if not _STAGED:
        atexit.register(release)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage. Tables that were broadcast and shuffled files live until
    it does, and it has no reason to while its heap may still grow; a plan's broadcasts would pile
    up on those of the plans before it."""
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Remove what ``stage`` wrote. Results that still read it are no longer valid."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass


def spread(df: DataFrame) -> DataFrame:
    """More partitions for Python stages, only where the input has fewer than there are cores
    (one small file); large inputs are split by size already and aren't shuffled."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows up to which a side of a join is broadcast; checked by counting a staged or small table.
BROADCAST_ROWS = 200_000


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join with a dimension. If ``right`` has at most ``limit`` rows it is broadcast; beyond that
    both sides are shuffled on the keys and a salt, ``right`` once per salt, so that a key with a
    third of all rows is spread over ``salts`` tasks. ``how`` is inner, left, left_semi or
    left_anti; ``right`` should be a staged or cheap table, it is counted first."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    rest = [c for c in left.columns]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
