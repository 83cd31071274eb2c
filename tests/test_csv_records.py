"""Records that span lines, against Python's csv module, with splits of a few hundred bytes."""

import csv
import io
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import types as T

from cartwheel.sources.csv import load_csv, load_csv_inferred, load_data, write_csv
from cartwheel.sources.records import BACKSLASH, DOUBLED, CsvLines

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@contextmanager
def splits_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _file(folder, text, name="t.csv"):
    path = folder / name
    path.write_bytes(text.encode())
    return str(path)


def _hard(rnd):
    return "".join(rnd.choice(["x", "y z", '"', '""', ",", "\n", "\n\n", "\r\n", " ", "é", '",', ',"', '"\n', "\x01"])
                   for _ in range(rnd.randint(0, 12)))


def _rows(rnd, n):
    return [(i, _hard(rnd), _hard(rnd)) for i in range(n)]


def _text(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "a", "b"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", [200, 1000, 10**6])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_the_csv_module(spark, tmp_path, size, end):
    rows = _rows(random.Random(size), 300)
    text = _text(rows, end)
    with splits_of(spark, size):
        lines = CsvLines(spark, _file(tmp_path, text), DOUBLED)
        assert lines.spans and (size > 10**5 or lines.splits.count() > 8)
        records = [r[0] for r in lines.records(header=True).collect()]
        assert lines.header() == "id,a,b"
    found = sorted((next(csv.reader(io.StringIO(r, newline=""))) for r in records), key=lambda r: int(r[0]))
    assert found == [[str(i), a, b] for i, a, b in rows]


@pytest.mark.parametrize("size", [300, 10**6])
def test_loaders_read_quoted_newlines(spark, tmp_path, size):
    rows = _rows(random.Random(3), 200)
    path = _file(tmp_path, _text(rows))
    want = [(i, a or None, b or None) for i, a, b in rows]
    with splits_of(spark, size):
        assert sorted(map(tuple, load_csv(spark, path, SCHEMA).collect())) == want
        df = load_csv_inferred(spark, path, na_tokens=("",))
        assert df.dtypes == [("id", "bigint"), ("a", "string"), ("b", "string")]
        assert sorted(map(tuple, df.collect())) == want


def test_several_files_and_headers_that_span_lines(spark, tmp_path):
    for k in range(4):
        body = "".join(f'{k * 10 + i},"p\nq{i}",r\n' for i in range(k * 3))
        _file(tmp_path, 'id,"two\nlines",a\n' + body, f"part-{k}.csv")
    with splits_of(spark, 16):
        df = load_csv_inferred(spark, str(tmp_path))
        assert df.columns == ["id", "two\nlines", "a"]
        assert sorted(map(tuple, df.collect())) == [(k * 10 + i, f"p\nq{i}", "r") for k in range(4) for i in range(k * 3)]


@pytest.mark.parametrize("size", [20, 10**6])
def test_an_unclosed_quote_fails(spark, tmp_path, size):
    path = _file(tmp_path, 'id,a,b\n1,"open,x\n' + "".join(f"{i},p,q\n" for i in range(2, 20)))
    with splits_of(spark, size):
        with pytest.raises(ValueError, match="never closed"):
            load_csv_inferred(spark, path)
        with pytest.raises(ValueError, match="never closed"):
            load_csv(spark, path, SCHEMA)
        with pytest.raises(ValueError, match="never closed"):
            load_data(spark, path, SCHEMA)


def test_round_trip_of_hard_texts(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(["a", " ", "\n", '"', ",", "\\", "\t", "\x01", "ü", "''"]) for _ in range(rnd.randint(1, 9))), " kept ")
            for i in range(300)]
    write_csv(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "out"))
    with splits_of(spark, 400):
        assert sorted(map(tuple, load_csv(spark, str(tmp_path / "out"), SCHEMA).collect())) == rows


def _mysql(value):
    """A field as a server writes it; a newline inside quotes may stand as it is."""
    if value is None:
        return "\\N"
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\0", "\\0").replace("\r", "\\r") + '"'


@pytest.mark.parametrize("size", [150, 10**6])
def test_load_data_reads_quoted_newlines(spark, tmp_path, size):
    rnd = random.Random(4)
    letters = ["x", "\n", "\\", '"', ",", "\x01", "\r", "\0", "n", "é", "\\n", '\\"']
    rows = [(i, *(rnd.choice([None, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 8)))]) for _ in range(2))) for i in range(200)]
    text = "".join(f"{i},{_mysql(a)},{_mysql(b)}\r\n" for i, a, b in rows)
    with splits_of(spark, size):
        path = _file(tmp_path, text)
        assert CsvLines(spark, path, BACKSLASH).spans
        got = load_data(spark, path, SCHEMA, header=False).collect()
    assert sorted(map(tuple, got)) == rows


def test_load_data_keeps_every_byte_and_blank_lines(spark, tmp_path):
    path = _file(tmp_path, "id,a,b\n1,ab\x01cd,\x01\n\n2,p\n")
    got = sorted(map(tuple, load_data(spark, path, SCHEMA).collect()), key=repr)
    assert got == sorted([(1, "ab\x01cd", "\x01"), (None, None, None), (2, "p", None)], key=repr)
    path = _file(tmp_path, "x\n\n", "text.csv")
    text = T.StructType([T.StructField("s", T.StringType())])
    assert sorted(r[0] for r in load_data(spark, path, text, header=False).collect()) == ["", "x"]


def test_lines_without_spanning_records_are_not_shuffled(spark, tmp_path):
    path = _file(tmp_path, "id,a,b\n" + "".join(f'{i},"p, q",r\n' for i in range(50)))
    lines = CsvLines(spark, path, DOUBLED)
    assert not lines.spans
    plan = lines.records(header=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_empty_inputs(spark, tmp_path):
    assert load_data(spark, _file(tmp_path, "", "e.csv"), SCHEMA).count() == 0
    assert load_data(spark, _file(tmp_path, "id,a,b\n", "h.csv"), SCHEMA).count() == 0
    assert load_csv_inferred(spark, _file(tmp_path, "id,a,b\n", "i.csv")).count() == 0


@pytest.mark.parametrize("spanning", [True, False])
@pytest.mark.parametrize("size", [150, 10**6])
def test_row_numbers_follow_the_files(spark, tmp_path, spanning, size):
    """From 0, by file and place, blank lines left out, whatever the splits."""
    rnd, want = random.Random(5), []
    for k in range(3):
        lines = ["id,a"]
        for i in range(rnd.randint(0, 60)):
            want.append(f"{k}-{i}")
            lines.append(f'{k}-{i},"x{chr(10) if spanning and i % 3 == 0 else " "}y"')
            if rnd.random() < 0.2:
                lines.append("")
        _file(tmp_path, "\n".join(lines) + "\n", f"part-{k}.csv")
    with splits_of(spark, size):
        df = load_csv_inferred(spark, str(tmp_path), index="row_no")
        got = sorted((r["row_no"], r["id"]) for r in df.collect())
    assert got == list(enumerate(want)) and df.columns == ["row_no", "id", "a"]


def test_only_records_that_span_splits_are_shuffled(spark, tmp_path):
    """Many records of several lines in few splits: the texts stay where they are read."""
    rows = [(i, "p\n" * (i % 5) + f"q{i}", "r,s\n") for i in range(25_000)]
    rows[20_000] = (20_000, "a\n" * 30_000, "t")  # of more lines than a batch
    path = _file(tmp_path, _text(rows))
    with splits_of(spark, 300_000):
        lines = CsvLines(spark, path, DOUBLED)
        records = [r[0] for r in lines.records(header=True).collect()]
        assert lines._pieces.count() <= 2 * lines.splits.count()
        whole = lines._assembled(pieces=False)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in whole and "SortMergeJoin" not in whole
    found = sorted((next(csv.reader(io.StringIO(r, newline=""))) for r in records), key=lambda r: int(r[0]))
    assert found == [[str(i), a, b] for i, a, b in rows]
