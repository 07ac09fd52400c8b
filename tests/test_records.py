"""CSV files whose cells hold line breaks, read by many tasks, against one task."""

import itertools
import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from failscope.sources import readers, records

SCHEMA = StructType([StructField(c, StringType()) for c in ("a", "b", "c d")])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rng):
    text = rng.choice(["plain", "", "two\nlines", 'said "no"', 'a,b\n"c"\n', "É" * 9, " lead", "x" * 200, '"', "\n\n", "tail "])
    if any(c in text for c in ',"\n') or rng.random() < 0.2:
        return '"' + text.replace('"', '""') + '"'
    return text


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,line_end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_many_tasks_read_what_one_reads(spark, tmp_path, small_splits, seed, line_end):
    rng = random.Random(seed)
    for name in ("one", "two"):
        lines = ["a,b,c d"] + [",".join(cell(rng) for _ in range(3)) for _ in range(120)]
        lines[40:40] = ['"' + "a long cell\n" * 150 + '",x,y', "5\" disk,it's \"so\",z", "", "short"]
        text = line_end.join(lines) + (line_end if name == "one" else "")
        (tmp_path / f"{name}.csv").write_bytes(text.encode() + (b"bad \xff byte,,\n" if name == "one" else b""))
    one = readers.scan_csv(spark, str(tmp_path), SCHEMA, whole_files=True)
    many = readers.scan_csv(spark, str(tmp_path), SCHEMA)
    assert rows_of(many) == rows_of(one) and many.count() > 240
    assert records.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    starts = records.inside_splits(records.lines_of(spark, str(tmp_path)).mapInArrow(
        records.split_functions, "file long, start long, from_outside int, from_inside int"))
    assert starts.count() > 3


def test_state_after_a_line_equals_a_walk_over_its_letters():
    def walk(line, inside):
        mode, i = "quoted" if inside else "start", 0
        while i < len(line):
            c = line[i]
            if mode == "start":
                mode = "quoted" if c == '"' else "start" if c == "," else "plain"
            elif mode == "quoted" and c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    mode = "plain"
            elif mode == "plain" and c == ",":
                mode = "start"
            i += 1
        return int(mode == "quoted")

    for n in range(7):
        for letters in itertools.product('x",', repeat=n):
            line = "".join(letters)
            for state in (0, 1):
                assert records.after(line.encode(), state) == walk(line, state), (line, state)


def test_header_alone_and_empty_files(spark, tmp_path):
    (tmp_path / "head.csv").write_bytes(b"a,b,c d\n")
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "open.csv").write_bytes(b'a,b,c d\n1,2,"never closed\nand on')
    (tmp_path / "split.csv").write_bytes(b'"a\nx",b,c d\n1,2,3\n')
    got = rows_of(readers.scan_csv(spark, str(tmp_path), SCHEMA))
    assert got == rows_of(readers.scan_csv(spark, str(tmp_path), SCHEMA, whole_files=True))
    assert ("1", "2", "3") in got and len(got) == 2
