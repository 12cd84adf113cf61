"""Session helpers: a local builder for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine assumes (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own setting, else (tests only) a temporary one.

    ``spark.checkpoint.dir`` names the folder on a cluster; a machine-local folder is used only where the
    session runs in one process and names none.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and return it without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, *conditions: Column) -> tuple[DataFrame, int, *tuple[int, ...]]:
    """``cut``, the number of rows, and of those where each condition holds; they are counted while the rows are written, without a job of their own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions)]))
    n = seen.get
    return out, n["rows"], *[n[f"c{i}"] for i in range(len(conditions))]


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` with its rows on the executors' disks while the block runs, for several passes over them.

    The lineage stays, so a lost executor costs time only. What is used after the block should be cut in it.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # the driver serves this file to the executors as long as the context lives
    path = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    sc.addPyFile(str(path))
    sc._plumbline_shipped = True
