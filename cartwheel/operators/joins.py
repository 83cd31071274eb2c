"""Broadcast a join side only behind a proof of its size.

AQE's runtime broadcast decision comes after both join inputs have been shuffled, so a big
side is shuffled even when the other one turns out tiny. When the small side is a computed
frame (one row per group, a filtered key set), ``bounded_broadcast`` materialises it once,
measures it, and hints a broadcast only when it takes at most ``max_bytes``; otherwise the
ordinary shuffle join (with AQE's skew splitting) stays in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.session import checkpoint_dir, scratch_path

# Default bound for broadcasting a computed side, in bytes as a hashed relation.
MAX_BROADCAST_BYTES = 64 << 20
ROW_OVERHEAD = 32  # of a row in a hashed relation: pointers, null bits, length


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: 8 a column, and the length of what has one."""
    size = F.lit(ROW_OVERHEAD + 8 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            size += F.coalesce(F.octet_length(F.col("`" + f.name.replace("`", "``") + "`").cast("string")), F.lit(0))
    return size


def materialize_bounded(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """(materialised frame, whether it takes at most ``max_bytes``).

    The frame is checkpointed into ``spark.checkpoint.dir`` (the shared folder; it is computed
    once, holds no executor memory afterwards and survives executor loss). Its size is one
    partial sum per task, so no rows are gathered to measure it.
    """
    checkpoint_dir(small.sparkSession)
    done = small.checkpoint(eager=True)
    return done, takes_at_most(done, max_bytes)


def takes_at_most(stored: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a stored frame takes at most ``max_bytes`` as a hashed relation."""
    return (stored.agg(F.sum(_row_bytes(stored))).first()[0] or 0) <= max_bytes


def bounded_broadcast(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(small)`` if it takes at most ``max_bytes``, else the materialised frame."""
    done, fits = materialize_bounded(small, max_bytes)
    return F.broadcast(done) if fits else done


def materialize_row(aggregate: DataFrame) -> DataFrame:
    """Checkpoint a one-row aggregate so its values can be read on the driver *and* feed the
    output plan without computing the aggregation (a full pass) a second time."""
    checkpoint_dir(aggregate.sparkSession)
    return aggregate.checkpoint(eager=True)


def materialize_table(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive input (a join, a parsed CSV) once as Parquet in the shared folder, for
    operators that read it in several passes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
