"""CSV records that may span lines, read by many tasks per file.

A file is read by physical line, so Spark splits it. Whether a line starts inside a quoted field
depends on all lines before it, but as a function of two possible states it can be told from the
line alone. The functions are composed within each split, the splits' compositions are scanned in
file order, and so every split learns its state. A task then joins the lines of its splits as it
reads them; only records that span splits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel.operators.joins import bounded_broadcast, materialize_bounded, materialize_table


@dataclass(frozen=True)
class Dialect:
    """``field``: a whole field with the comma before it (one group around the field itself);
    ``unclosed``: a comma and a quoted field that a line's end interrupts."""

    field: str
    unclosed: str


# Quotes are doubled inside quotes; what follows a closing quote belongs to the field (pandas).
DOUBLED = Dialect(r',("(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)', r',"(?:[^"]++|"")*+')
# The backslash escapes too, and nothing but a comma follows a closing quote (LOAD DATA).
BACKSLASH = Dialect(r',("(?:[^"\\]++|\\.|"")*+"|(?!")(?:[^,\\]++|\\.)*+)', r',"(?:[^"\\]++|\\.|"")*+\\?')

SPLIT = ["file", "block"]


def _stays_open(text: Column, dialect: Dialect) -> Column:
    """Whether a text that starts a record ends inside quotes."""
    return F.concat(F.lit(","), text).rlike(rf"(?s)^(?:{dialect.field})*+{dialect.unclosed}\z")


class CsvLines:
    """The physical lines of the CSV files at ``path``.

    ``spans``: whether any record spans lines. Building it reads the files once, for one row per
    split.
    """

    def __init__(self, spark: SparkSession, path: str, dialect: Dialect):
        self.dialect = dialect
        # Line numbers are those of the scan, which deals out equal splits each time it is read.
        self.lines = spark.read.option("lineSep", "\n").text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"))
        quoted = F.col("value").contains('"')
        self.opens = quoted & _stays_open(F.col("value"), dialect)
        # The same line, started inside a quoted field.
        self.stays = ~quoted | _stays_open(F.concat(F.lit('"'), F.col("value")), dialect)
        self.splits, _ = materialize_bounded(self.lines.groupBy(*SPLIT).agg(
            F.min("id").alias("first"), F.count_if(self.opens).alias("opens")))
        self.spans = bool(self.splits.agg(F.sum("opens")).first()[0])

    def _heads(self) -> DataFrame:
        return self.splits.where("block = 0").select(F.col("first").alias("id"))

    @cached_property
    def _starts(self) -> tuple[DataFrame, bool]:
        """(stored frame, whether it fits a broadcast): file, block, start (whether the split starts
        inside quotes). Fails where a file ends inside quotes."""
        def odd(n: Column) -> Column:
            return n % 2 == 1

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each split's state at its end, if it starts outside and if it starts inside quotes."""
            def row() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({"file": [split[0]], "block": [split[1]], "o": [bool(both[0])], "k": [bool(both[1])]})

            split, both = None, (False, True)
            for batch in batches:
                opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("o", "k"))
                for own, a, b in runs(batch):
                    if own != split:
                        if split is not None:
                            yield row()
                        split, both = own, (False, True)
                    both = [after(s, opens[a:b], stays[a:b])[-1] for s in both]
            if split is not None:
                yield row()

        runs, after = _line_functions()
        over = Window.partitionBy("file").orderBy("block")
        last = self.lines.select(*SPLIT, self.opens.alias("o"), self.stays.alias("k")).mapInArrow(
            ends, "file string, block long, o boolean, k boolean")
        # A split keeps the state, sets it (``fixed``), or (opens & ~stays) swaps it.
        splits = last.select(*SPLIT, F.when(F.col("o") == F.col("k"), F.col("o")).alias("fixed"), F.col("o").alias("swap"))
        splits = splits.withColumn("n", F.sum(F.when(F.col("fixed").isNull() & F.col("swap"), 1).otherwise(0)).over(over))
        splits = splits.withColumn("at", F.last(F.when(F.col("fixed").isNotNull(), F.struct(F.col("fixed").alias("s"), "n")), True).over(over))
        end = F.coalesce(F.col("at.s") != odd(F.col("n") - F.col("at.n")), odd(F.col("n")))  # a file starts outside quotes
        splits = splits.select(*SPLIT, end.alias("end"))
        splits = materialize_table(splits.select(*SPLIT, F.lag("end", 1, False).over(over).alias("start"), "end"), "csv-splits")
        broken = splits.groupBy("file").agg(F.max_by("end", "block").alias("end")).where("end").limit(3).collect()
        if broken:
            raise ValueError("quotes do not fit: a quoted field is never closed in " + ", ".join(r["file"] for r in broken))
        return materialize_bounded(splits.select(*SPLIT, "start"))

    def _assembled(self, *, pieces: bool) -> DataFrame:
        """id (of the first line), file, block, record, own of the records that lie in one split; with
        ``pieces``, of the parts of all others, where ``own`` tells those that start a record.

        Each task joins its own lines as it reads them, so nothing is shuffled."""
        def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(ids: list, texts: pa.Array, own: bool) -> pa.RecordBatch:
                n = len(ids)
                return pa.RecordBatch.from_pydict({
                    "id": pa.array(ids, pa.int64()), "file": pa.array([split[0]] * n, pa.string()),
                    "block": pa.array([split[1]] * n, pa.int64()), "record": texts, "own": pa.array([own] * n, pa.bool_())})

            def ended(closed: bool) -> Iterator[pa.RecordBatch]:
                if held and pieces != (held[1] and closed):
                    yield rows([held[0]], pa.array(["\n".join(held[2])], pa.string()), held[1])

            split, state, held = None, False, None  # held: id, whether it starts a record, lines
            for batch in batches:
                opens, stays = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("o", "k"))
                ids = batch.column("id").to_numpy()
                for this, a, b in runs(batch):
                    if this != split:
                        yield from ended(not state)
                        split, state, held = this, batch.column("start")[a].as_py(), None
                    then = after(state, opens[a:b], stays[a:b])
                    starts = np.flatnonzero(~np.append(state, then[:-1])) + a
                    state = bool(then[-1])
                    values = batch.column("value")
                    first = int(starts[0]) if len(starts) else b
                    if first > a:  # lines of a record that began before
                        held = held or (int(ids[a]), False, [])
                        held[2].extend(values.slice(a, first - a).to_pylist())
                    if len(starts):
                        yield from ended(True)
                        if len(starts) > 1 and not pieces:
                            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
                            yield rows(ids[starts[:-1]].tolist(), pc.binary_join(lists, "\n"), True)
                        at = int(starts[-1])
                        held = (int(ids[at]), True, values.slice(at, b - at).to_pylist())
            yield from ended(not state)

        runs, after = _line_functions()
        starts, fits = self._starts
        lines = self.lines.select(*SPLIT, "id", "value", self.opens.alias("o"), self.stays.alias("k"))
        if fits:
            lines = lines.join(F.broadcast(starts), SPLIT)
        else:  # so many splits that the join may shuffle the lines
            lines = lines.join(starts, SPLIT).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "id")
        return lines.mapInArrow(assemble, "id long, file string, block long, record string, own boolean")

    def records(self, *, header: bool) -> DataFrame:
        """``record`` rows: the text of each, without the line end; with ``header``, without the
        first of each file."""
        return self._placed(header).select(_without_cr(F.col("record")).alias("record"))

    def _placed(self, header: bool) -> DataFrame:
        """id (of the first line), file, block, record."""
        rows = self.lines.withColumnRenamed("value", "record")
        if self.spans:
            whole = self._assembled(pieces=False).select("id", *SPLIT, "record")
            rows = whole.unionByName(self._joined(self._pieces))
        return rows.join(bounded_broadcast(self._heads()), "id", "left_anti") if header else rows

    def numbered(self, *, header: bool, name: str = "row_no") -> DataFrame:
        """``record`` and ``name``: the record's number from 0, by file path and place in the file.

        Blank records have no number and are left out. Each split's records are counted and the
        counts summed up in order, so no task sees more than its own rows and one row per split.
        Records stay where the scan put them; only where some span lines are they sorted by place,
        in a shuffle.
        """
        rows = self._placed(header).where(F.trim("record") != "")
        if self.spans:
            tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            order = ["file", "block", "id"]
            rows = materialize_table(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
                                     .withColumn("at", F.monotonically_increasing_id()), "csv-records")
            task = F.shiftright("at", 33)  # tasks are in order
            counts = rows.groupBy(task.alias("of")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
            before = F.sum("n").over(Window.orderBy("of")) - F.col("n")
            starts = counts.select("of", "low", before.alias("before"))
            rows = rows.join(bounded_broadcast(starts), task == F.col("of"))
        else:
            # Counted after the filters; the scan deals out the same rows each time it is read.
            rows = rows.withColumn("at", F.monotonically_increasing_id())
            counts = rows.groupBy(*SPLIT).agg(F.min("at").alias("low"), F.count("*").alias("n"))
            before = F.sum("n").over(Window.orderBy(*SPLIT)) - F.col("n")
            rows = rows.join(bounded_broadcast(counts.select(*SPLIT, "low", before.alias("before"))), SPLIT)
        return rows.select(_without_cr(F.col("record")).alias("record"), (F.col("before") + F.col("at") - F.col("low")).alias(name))

    @cached_property
    def _pieces(self) -> DataFrame:
        """id, file, block, record, own, of the records that span splits, stored."""
        return materialize_table(self._assembled(pieces=True), "csv-pieces")

    def _joined(self, pieces: DataFrame) -> DataFrame:
        """id, file, block (of the first line), record of the records that span splits."""
        over = Window.partitionBy("file").orderBy("block", "id")
        of = pieces.select("file", "block", "id", F.last(F.when(F.col("own"), F.col("id")), True).over(over).alias("of"))
        rows = pieces.join(of.select("id", "of"), "id").groupBy("of").agg(
            F.array_sort(F.collect_list(F.struct("block", "id", "record"))).alias("parts"), F.first("file").alias("file"))
        return rows.select(F.col("of").alias("id"), "file", F.col("parts")[0]["block"].alias("block"),
                           F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record"))

    def header(self) -> str | None:
        """The first record of the first file, by path; None without a line."""
        heads = self.splits.where("block = 0").select("file", F.col("first").alias("id"))
        first = heads.orderBy("file").limit(1)
        rows = self._placed(False)
        found = rows.join(F.broadcast(first.select("id")), "id", "left_semi").select(_without_cr(F.col("record"))).first()
        return found and found[0]


def _line_functions() -> tuple:
    """For the workers, which need not have this package: functions made here go with the job.

    ``runs``: (split, first, end) of each run of a batch's lines that are of one split. ``after``: the
    state after each line, given the first one's start and what each does if started outside
    (``opens``) or inside quotes (``stays``)."""
    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        file, block = batch.column("file"), batch.column("block")
        if not len(file):
            return
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(file)]
        for a, b in zip(edges, edges[1:]):
            yield (file[a].as_py(), block[a].as_py()), a, b

    def after(start: bool, opens: np.ndarray, stays: np.ndarray) -> np.ndarray:
        # A line keeps the state, sets it, or (opens & ~stays) swaps it.
        known = np.maximum.accumulate(np.where(opens == stays, np.arange(len(opens)), -1))
        swaps = np.cumsum(opens & ~stays)
        since = np.where(known >= 0, swaps - swaps[known], swaps)
        return np.where(known >= 0, opens[known], start) ^ (since % 2 == 1)

    return runs, after


def _without_cr(c: Column) -> Column:
    return F.when(c.endswith("\r"), F.left(c, F.length(c) - 1)).otherwise(c)
