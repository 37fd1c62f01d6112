"""Quoted CSV in splits against the reader that takes files whole."""

import random

import pytest

from noteweave.sources.bookmarks import csv_reader, read_bookmarks

HEADER = "title,url,time_added,tags,status\n"


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def records(seed, count, end):
    rnd = random.Random(seed)
    pieces = ["word ", "ö語 ", ", ", '"', "\n", end, "long " * 30, ""]
    out = []
    for n in range(count):
        fields = [f"t{n} " + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9))), f"https://e.com/{n}", str(n), rnd.choice(["", "a,b", 'x "y"\nz']), "read"]
        fields = fields[: rnd.choice([5, 5, 5, 5, 4])] + ["more"] * (n % 13 == 7)
        out.append(",".join(quoted(f) if set(f) & set('",\r\n') or rnd.random() < 0.3 else f for f in fields) + end)
        if rnd.random() < 0.05:
            out.append(end)
    return "".join(out)


def rows(table):
    return sorted(tuple(r) for r in table.select("row_idx", "title", "url", "time_added", "tags", "status").collect())


@pytest.mark.parametrize("seed, split, end", [(1, "300", "\n"), (2, "97", "\n"), (3, "1000", "\r\n"), (4, "128m", "\n"), (5, "41", "\n")])
def test_splits_give_the_rows_of_the_whole_file(spark, tmp_path, seed, split, end):
    for n, name in enumerate(("a.csv", "b c.csv")):
        (tmp_path / name).write_bytes((HEADER.replace("\n", end) + records(seed + 10 * n, 60, end)).encode())
    path = str(tmp_path)
    want = [tuple(r) for name in ("a.csv", "b c.csv") for r in csv_reader(spark.read, multi_line=True).csv(f"{path}/{name}").drop("_corrupt_record").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = read_bookmarks(spark, path, multi_line=True)
        got = rows(table)
        tasks = spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(n, *r) for n, r in enumerate(want)] and (split == "128m" or tasks > 5)


def test_one_field_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {n}" for n in range(400))
    (tmp_path / "a.csv").write_text(HEADER + f'{quoted(long)},u1,1,,read\nt2,u2,2,,read\n{quoted(long)},u3,3,,{quoted("x" + chr(10))}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = rows(read_bookmarks(spark, str(tmp_path), multi_line=True))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(0, long, "u1", "1", None, "read"), (1, "t2", "u2", "2", None, "read"), (2, long, "u3", "3", None, "x\n")]


def test_files_whose_quotes_do_not_pair_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + 'a 5" disk,u1,1,,read\nt2,u2,2,,read\n')
    (tmp_path / "b.csv").write_text(HEADER + '"x\ny",u3,3,,read\n')
    assert [r[:3] for r in rows(read_bookmarks(spark, str(tmp_path), multi_line=True))] == [(0, 'a 5" disk', "u1"), (1, "t2", "u2"), (2, "x\ny", "u3")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER)
    (tmp_path / "b.csv").write_text("")
    assert read_bookmarks(spark, str(tmp_path), multi_line=True).count() == 0
