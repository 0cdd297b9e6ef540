"""Tables cut from their lineage, in the folder that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests), a temporary folder.  On a
    cluster no local folder is shared, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="hydroframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_ROOTS: list[str] = []


def sweep(spark: SparkSession, since: int, keep: Store) -> int:
    """Deletes the tables of all stores made after the first ``since`` ones, but for ``keep``'s; returns
    the number of stores to pass next time."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for root in _ROOTS[since:]:
        if root != keep.root:
            path(root).getFileSystem(conf).delete(path(root), True)
    return len(_ROOTS)


class Store:
    """Writes intermediate tables as Parquet and removes those no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        text_batches(spark)
        self.root = f"{shared_dir(spark)}/hydroframe-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self.made = 0
        self.shared: list = []

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._hydroframe_path = path
        return out

    def share(self, value):
        """A broadcast of ``value``; ``release`` it once the tables that need it are written."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def release(self) -> None:
        """Destroys the broadcasts made by ``share``."""
        while self.shared:
            self.shared.pop().destroy()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if hasattr(t, "_hydroframe_path"):
                path = jvm.org.apache.hadoop.fs.Path(t._hydroframe_path)
                path.getFileSystem(conf).delete(path, True)


#: Rows of text in an Arrow batch: some MB, where Spark's 10000 rows may be hundreds.
TEXT_ROWS = 1000
GROUP_BYTES = 64 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session for rows that hold texts."""
    if not 0 < int(spark.conf.get(_ROWS)) <= TEXT_ROWS:
        spark.conf.set(_ROWS, str(TEXT_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame) -> int:
    """Groups to deal packed records into: four for each shuffle partition, or one for each
    ``GROUP_BYTES`` that the planner takes the input for, so that no group grows with the data."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * partitions(df.sparkSession), min(size // GROUP_BYTES, 1 << 30))
