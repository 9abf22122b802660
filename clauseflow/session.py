"""Session helpers: the shared checkpoint folder, and tables written into it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_session(app: str = "clauseflow", cpus: int | str = "*") -> SparkSession:
    """A local session with the settings the engine assumes (adaptive execution, UTC, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and the master is local, a folder of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    own = getattr(spark, "_clauseflow_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="clauseflow-")
        spark._clauseflow_dir = own
    return own


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once: they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_clauseflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="clauseflow-ship-")) / "clauseflow.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._clauseflow_shipped = True


class Shelf:
    """Tables written to the shared folder. A written table cuts lineage and survives the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        spark.__dict__.setdefault("_clauseflow_shelves", []).append(self.base)
        self.n = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as read back from the written files."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._shelf_path = path
        return out

    def put_seen(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """`put`, and aggregates over the rows written, taken while they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
        return out, seen.get

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in dfs:
            path = getattr(df, "_shelf_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def clear_shelves(spark: SparkSession) -> int:
    """Deletes all tables that this session's operators have written between their steps, and tells how many shelves went. For use once results
    are written: a result that is still lazy reads these tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    bases = spark.__dict__.pop("_clauseflow_shelves", [])
    for base in bases:
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(conf).delete(path, True)
    return len(bases)
