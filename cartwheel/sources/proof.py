"""Proof that a table's key is unique, kept with the table.

``publish`` writes a table aside, counts and fingerprints it, refuses it if its key repeats, and
only then swaps it in, manifest included; a reader never sees a refused table. ``proven_key``
believes a manifest only while the table's files are those it lists, and ``recount`` reads the
table again and compares rows and fingerprint.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_key_proof.json"   # readers skip names that begin with an underscore
SHOWN = 5


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, null among them (empty when ``key`` is unique)."""
    return df.groupBy(key).count().where(F.col("count") > 1)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, order-free digest of all rows): sums and exclusive ors of two hashes of each row."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    if not columns:
        return df.count(), ""
    rows = df.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    wide = [F.sum(F.col(c).cast("decimal(20,0)")) for c in "ab"]
    found = rows.agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b"), *wide).first()
    return found[0], hashlib.sha256(",".join(map(str, found[1:])).encode()).hexdigest()


class _Files:
    """The file system that holds ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.jvm, self.root = spark._jvm, self.path_of(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def data_files(self, path: str) -> str | None:
        """A digest of name and length of all files of a table; None if there is no such folder."""
        root = self.path_of(path)
        if not self.fs.exists(root):
            return None
        base, found = self.fs.makeQualified(root).toString().rstrip("/"), []
        walk = self.fs.listFiles(root, True)
        while walk.hasNext():
            f = walk.next()
            name = f.getPath().toString()[len(base):]
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                found.append(f"{name} {f.getLen()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path_of(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str | None:
        where = self.path_of(path)
        if not self.fs.exists(where):
            return None
        opened = self.fs.open(where)
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def remove(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path_of(old), self.path_of(new)):
            raise OSError(f"could not rename {old} to {new}")


def publish(spark: SparkSession, writer: DataFrameWriter, path: str, key: str, *, name: str, source: str) -> None:
    """Write a table by ``writer`` and make it the one at ``path`` if ``key`` is unique in it.

    The table is written beside ``path``, under a name that readers of the parent skip. A repeated
    key raises ValueError; then, and on any other failure before the swap, the copy is removed and
    what stood at ``path`` stays. The swap is two renames; if the second fails, the first is undone.
    """
    path = path.rstrip("/")
    parent, _, leaf = path.rpartition("/")
    token = os.urandom(4).hex()
    staged, old = (f"{parent}/_{kind}-{leaf}-{token}" if parent else f"_{kind}-{leaf}-{token}" for kind in ("staged", "old"))
    files = _Files(spark, path)
    try:
        writer.mode("errorifexists").parquet(staged)
        table = spark.read.parquet(staged)
        again = duplicate_keys(table, key).limit(SHOWN).collect()
        if again:
            shown = ", ".join(str(r[key]) for r in again)
            raise ValueError(f"{name}: {key} is repeated ({shown}, ...); repair {source}; {path} is left as it was")
        rows, digest = fingerprint(table)
        files.write(f"{staged}/{MANIFEST}", json.dumps(
            {"table": name, "key": key, "rows": rows, "fingerprint": digest, "files": files.data_files(staged)}))
        there = files.fs.exists(files.path_of(path))
        if there:
            files.rename(path, old)
        try:
            files.rename(staged, path)
        except BaseException:
            if there:
                files.rename(old, path)
            raise
    except BaseException:
        files.remove(staged)
        raise
    if there:
        files.remove(old)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    text = _Files(spark, path).read(f"{path.rstrip('/')}/{MANIFEST}")
    return json.loads(text) if text else None


def proven_key(spark: SparkSession, path: str) -> str | None:
    """The column proven unique in the table at ``path``; None without a manifest, or where its
    files are no longer those of the manifest. Reads no data."""
    found = _manifest(spark, path)
    if found and found["files"] == _Files(spark, path).data_files(path):
        return found["key"]
    return None


def recount(spark: SparkSession, path: str) -> bool:
    """Whether rows and fingerprint of the table are those of its manifest (one pass over it)."""
    found = _manifest(spark, path)
    return bool(found) and (found["rows"], found["fingerprint"]) == fingerprint(spark.read.parquet(path))
