"""Intermediate tables with a life span.

Paths from ``scratch_path`` and tables from ``shared_table`` belong to the innermost open
``scratch_scope``, and go with it, whether its block succeeds or fails. Outside any scope they
belong to the session: they go when it stops, or with its JVM.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cartwheel.session import checkpoint_dir, remove_path


@dataclass
class _Scope:
    spark: SparkSession
    paths: list[str] = field(default_factory=list)
    #: (name, hash of the plan, state of its input files) -> (frame, its stored copy) pairs.
    shared: dict[tuple, list[tuple[DataFrame, DataFrame]]] = field(default_factory=dict)
    outer: _Scope | None = None

    def remove(self) -> None:
        self.shared.clear()
        while self.paths:
            remove_path(self.spark, self.paths.pop())


_SESSIONS: dict[str, _Scope] = {}
_OPEN: ContextVar[_Scope | None] = ContextVar("scratch_scope", default=None)
# The folder that setCheckpointDir makes for one application.
_OWN_FOLDER = re.compile(r"/[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}/?$")


def _session_scope(spark: SparkSession) -> _Scope:
    sc = spark.sparkContext
    scope = _SESSIONS.get(sc.applicationId)
    if scope is None:
        scope = _SESSIONS[sc.applicationId] = _Scope(spark)
        folder = checkpoint_dir(spark)
        if _OWN_FOLDER.search(folder):
            scope.paths.append(folder)
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)  # if nobody stops the session
        stop = sc.stop

        def stop_and_remove() -> None:
            try:
                if _SESSIONS.pop(sc.applicationId, None):
                    scope.remove()
            finally:
                sc.stop = stop
                stop()

        sc.stop = stop_and_remove
    return scope


def _innermost(spark: SparkSession) -> _Scope:
    scope = _OPEN.get()
    return scope if scope is not None and scope.spark.sparkContext is spark.sparkContext else _session_scope(spark)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end, also on failure, every scratch table asked for inside. What is returned
    from the block must not read them any more."""
    scope = _Scope(spark, outer=_innermost(spark))
    token = _OPEN.set(scope)
    try:
        yield
    finally:
        _OPEN.reset(token)
        scope.remove()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, removed with the innermost scope. (A Spark Connect
    session has no file system of its own here: its folder's owner removes it.)"""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{os.getpid()}-{os.urandom(4).hex()}"
    if _has_context(spark):
        _innermost(spark).paths.append(path)
    return path


def _has_context(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext is not None
    except Exception:  # noqa: BLE001 - what a Connect session raises differs by version
        return False


def _files_state(df: DataFrame) -> str:
    """A digest of name, length and time of the files beside and among the inputs of ``df``."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    digest = hashlib.sha256()
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(where.getFileSystem(conf).listStatus(where))
        digest.update(re.sub(r"access_time=\d+", "", listed).encode())
    return digest.hexdigest()


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df``, stored once as Parquet and reused wherever an open scope already holds an equal one.

    Equal are frames of the same ``name`` whose plans give the same result by Spark's own
    comparison, over input files that have not changed. A plan that is not deterministic is stored
    anew each time.
    """
    spark = df.sparkSession
    key = (name, df.semanticHash(), _files_state(df))
    own = scope = _innermost(spark)
    if df._jdf.queryExecution().analyzed().deterministic():
        while scope is not None:
            for known, stored in scope.shared.get(key, ()):
                if known.sameSemantics(df):
                    return stored
            scope = scope.outer
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    own.shared.setdefault(key, []).append((df, stored))
    return stored
