"""Helpers that several corpus operators use."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names the folder in `spark.checkpoint.dir`. Only a local session without that setting gets one of its own.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = context.getCheckpointDir()
        if not root:
            root = tempfile.mkdtemp(prefix="spark-shared-")
            context.setCheckpointDir(root)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return f"{root}/{uuid.uuid4().hex}"


#: Folders of frames that `stored` wrote: those of the open scratch scopes, innermost last, and those that stay until `clear`.
_scopes: list[list[str]] = []
_kept: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (_scopes[-1] if _scopes else _kept).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Frames that are stored inside are deleted at the end; what is needed later goes through `kept`."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.pop())


def kept(df: DataFrame) -> DataFrame:
    """Store a frame for the scope around the open one: until that ends or, if there is none, until `clear`."""
    inner = _scopes.pop()
    try:
        return stored(df)
    finally:
        _scopes.append(inner)


def clear(spark: SparkSession) -> None:
    """Delete what the results of this session's operators read. Call it once they have been written or collected."""
    _delete(spark, _kept)
    _kept.clear()


def keep_until_clear(path: str) -> str:
    """Note a folder for `clear`, or for the end of the open scope."""
    (_scopes[-1] if _scopes else _kept).append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete one folder of the shared ones now."""
    _delete(spark, [path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that hold more than this share of all rows are joined apart; so there are at most that many.
HOT = 4096


def join_split(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of `left` with one row a key of `right`, whose column `count` says how many rows of `left` have the key.

    A shuffle would bring all rows of a key to one task. Keys with more than a share of 1 / HOT of the `total` rows are at most
    HOT, whatever the data; their rows of `right` are broadcast, and their rows of `left` stay where they are. `total` may be
    too large, which makes fewer keys hot.
    """
    border = max(1, total // HOT)
    hot, rest = right.where(F.col(count) > border).drop(count), right.where(F.col(count) <= border).drop(count)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(rest, keys))
