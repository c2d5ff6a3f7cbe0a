"""CSV read in splits against Python's reader."""

import csv
import io
import random

import pytest

from labelloom.sources import readers, split_csv


def write(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


def cells(rng):
    pool = ["plain", "", "N/A", 'say "hi"', "two\nlines", "a,b", "\n\n", '"', 'é😀,"\n"', "x" * 90, "lines\n" * 7]
    return [rng.choice(pool) for _ in range(3)]


def want(rows):
    null = lambda v: None if v in ("", "N/A") else v
    return sorted([tuple(map(null, r)) for r in rows], key=str)


@pytest.mark.parametrize("size", [37, 64, 500, None])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_pythons_reader(spark, tmp_path, size, end):
    rng = random.Random(f"{size}{end}")
    rows = [[str(i), *cells(rng)] for i in range(80)]
    (tmp_path / "in.csv").mkdir()
    write(tmp_path / "in.csv" / "a.csv", [["k", "x", "y", "z"], *rows[:50]], end)
    write(tmp_path / "in.csv" / "b.csv", [["k", "x", "y", "z"], *rows[50:]], end)
    got = split_csv.read_csv_split(spark, str(tmp_path / "in.csv"), size=size)
    assert got.columns == ["k", "x", "y", "z"]
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)


def test_a_record_over_many_splits(spark, tmp_path):
    rows = [["1", "short"], ["2", "line\n" * 300 + 'the "end"'], ["3", "after"]]
    write(tmp_path / "in.csv", [["k", "x"], *rows])
    got = split_csv.read_csv_split(spark, str(tmp_path / "in.csv"), "k int, x string", size=50)
    assert sorted(map(tuple, got.collect())) == [(int(k), x) for k, x in rows]
    parts = split_csv.records(spark, str(tmp_path / "in.csv"), 50).select("block").distinct().count()
    assert parts > 1


def test_like_the_plain_reader(spark, tmp_path):
    write(tmp_path / "in.csv", [["k", "x"], ["1", "a\nb"], ["2", "null"], ["x", "bad number"], ["4", 'q "q" q']])
    plain = readers.read_csv(spark, str(tmp_path / "in.csv"), "k int, x string").collect()
    split = readers.read_csv(spark, str(tmp_path / "in.csv"), "k int, x string", multiline="split").collect()
    assert sorted(map(tuple, split), key=str) == sorted(map(tuple, plain), key=str)


def test_edges(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert split_csv.read_csv_split(spark, str(tmp_path / "empty.csv"), "k int").count() == 0
    (tmp_path / "head.csv").write_text("﻿k,x\n")
    assert split_csv.read_csv_split(spark, str(tmp_path / "head.csv")).columns == ["k", "x"]
    (tmp_path / "open.csv").write_text('k,x\n1,"never closed\n2,b\n')
    assert split_csv.read_csv_split(spark, str(tmp_path / "open.csv"), size=8).count() == 1
    with pytest.raises(ValueError):
        split_csv.read_csv_split(spark, str(tmp_path / "head.csv"), "a int, b string")
