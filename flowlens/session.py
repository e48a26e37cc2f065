"""Session helpers shared by every operator: package shipping, table access, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of an Arrow batch, where the session leaves Spark's default: whole texts go through Python, and a batch of
#: 10,000 of them is held several times over, by the JVM outside its heap and by the worker.
BATCH_ROWS = "500"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python workers can import it, and bounds Arrow batches
    where the session says nothing about them."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="flowlens-ship-")
    target = os.path.join(folder, "flowlens_pkg.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, f"flowlens/{path.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 8_000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes: for small rows, a batch of BATCH_ROWS costs more than what is in it."""
    held: list[pa.RecordBatch] = []
    n = weight = 0
    for batch in batches:
        held.append(batch)
        n, weight = n + batch.num_rows, weight + batch.nbytes
        if n >= rows or weight >= size:
            yield pa.concat_batches(held)
            held, n, weight = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir. Only a local master may fall back to its own temp folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "flowlens-checkpoints")


def spread(spark: SparkSession) -> int:
    """Into how many parts rows are dealt that cost more in Python than they weigh: Spark would read a small file in few tasks."""
    return 4 * spark.sparkContext.defaultParallelism


def whole_spread(spark: SparkSession) -> int:
    """The same for keys: as many parts as shuffles have here, if those are more. As a number, so that adaptive planning leaves it: it would
    join the parts to one or two more than there are cores, and those would wait for a second round."""
    return max(spread(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def files_for(rows: int, each: int = 200_000) -> int:
    """How many files a table of small rows deserves."""
    return max(1, -(-rows // each))


def materialize(df: DataFrame, files: int | None = None, gather: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage is cut, and lost executors lose nothing.

    files: at most so many, where the rows are known to be few; many small files cost more than they hold. The rows are then
    made by as many tasks, or, with gather, by as many tasks as it takes, and dealt to the writers.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.repartition(files) if gather else df.coalesce(files)
    path = f"{shared_dir(spark)}/flowlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Deletes the tables that materialize() wrote; results not yet consumed become unreadable."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at interpreter exit
            return


atexit.register(cleanup)
