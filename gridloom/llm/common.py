"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns (all if none is given) of one Parquet table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On a cluster it is ``spark.checkpoint.dir``, or the folder that was given to ``setCheckpointDir``.  Only where both
    are unset in a local session (tests) a temporary folder of this machine is made and kept as that folder.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        current = sc.getCheckpointDir()
    return current


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors, and later passes read only the columns
    they need.  The table is removed by ``discard`` or ``settled``, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    _live.paths[path] = None
    return table


class _Live(threading.local):
    """Stored tables of this thread that haven't been removed: ``settled`` must not remove what another thread makes."""

    def __init__(self):
        self.paths: dict[str, None] = {}


_live = _Live()


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        _live.paths.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made of them has been stored in turn."""
    for table in tables:
        _remove(table.sparkSession, [table._stored_at])


def settled(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``make``; the tables that were stored to make it are removed, since nothing else reads them."""
    before = set(_live.paths)
    out = stored(make(), name)
    _remove(out.sparkSession, [p for p in _live.paths if p not in before and p != out._stored_at])
    return out


#: Largest table that is broadcast, by its values' bytes.
BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    parts = [F.octet_length(F.col(f"`{c}`")) if k in ("string", "binary") else F.octet_length(F.to_json(F.struct(f"`{c}`"))) if k in ("array", "struct", "map") else F.lit(8) for c, k in kinds.items()]
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


def small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``max_rows`` rows and ``max_bytes`` of values (they are summed up, never collected)."""
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(_bytes(df))).first()
    return n <= max_rows and (size or 0) <= max_bytes


def joinable(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is proven to be no larger than this, else as it is."""
    return F.broadcast(df) if small(df, max_rows, max_bytes) else df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``taken`` has."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        own = f"_{name}"
        while own.lower() in used:
            own = f"_{own}"
        used.add(own.lower())
        out.append(own)
    return out


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, also where ``then`` uses it in lambda functions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches of few rows, so that few texts are held as Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only.

    ``lower`` does just that where all characters are ASCII, and it is much faster than ``translate``.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))
