"""Tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the session runs on one machine, as in
tests, a temporary one stands in. A written table cuts lineage: an executor lost later costs no recomputation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []
_KEPT: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, or a temporary one if a session on one machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; what lies there goes when this program ends."""
    if not _MADE:
        atexit.register(_clear)
    _MADE.append(f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def once(spark: SparkSession, label: str, build: Callable[[str], object]) -> str:
    """The folder that ``build`` filled for ``label`` in this program; it is called again only if that is gone."""
    path = _KEPT.get(label)
    if path is None or path not in _MADE or not exists(spark, path):
        path = new_path(spark, "kept")
        build(path)
        _KEPT[label] = path
    return path


def clear(spark: SparkSession) -> None:
    """Delete all tables made so far, for sessions that outlive their queries; nothing may read them any more."""
    while _MADE:
        path = _MADE.pop()
        for end in ("", "-progress"):
            _delete(spark, path + end)


def _clear() -> None:
    """Delete all tables of this program, if its session still lives; else they stay for whoever clears the folder."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        clear(spark)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage before that file."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._docloom_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`table` that nothing reads any more."""
    path = getattr(df, "_docloom_path", None)
    if path:
        _delete(df.sparkSession, path)
