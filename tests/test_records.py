"""Files with line breaks inside quoted fields, cut into records by many tasks."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.sources import feeds
from tallybook.sources.records import ends_inside, read_records

NAMES = ["h1", "h2", "h3"]


def field(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice("ab c1") for _ in range(rng.randint(0, 5)))
    if kind < 0.5:
        return 'x"y'
    body = "".join(rng.choice(["a", "\n", '""', ",", " ", "bb", "\n\n", "é"]) for _ in range(rng.randint(0, 9)))
    return f'"{body}"' + (rng.choice(["", "zz"]) if rng.random() < 0.1 else "")


def lines(seed: int, n: int = 800) -> list[str]:
    rng = random.Random(seed)
    return [",".join(NAMES)] + [f"{i},{field(rng)},{field(rng)}" for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some hundred bytes, so that records cross several of them."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def whole_file(spark, path: str) -> list:
    return sorted(map(repr, spark.read.options(**feeds.CSV_FORM, multiLine=True).csv(path).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_same_rows_as_reading_whole_files(spark, tmp_path, small_ranges, seed):
    for i in range(2):
        (tmp_path / f"part{i}.csv").write_text("\n".join(lines(10 * seed + i)) + ("\n" if i else ""))
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    got = feeds.read_feed(spark, path, NAMES)
    assert sorted(map(repr, got.collect())) == whole_file(spark, path)


def test_carriage_returns(spark, tmp_path, small_ranges):
    """They end records, and stay inside fields, where the reader of whole files turns them into line feeds."""
    (tmp_path / "f.csv").write_bytes("\r\n".join(lines(7)).encode())
    got = feeds.read_feed(spark, str(tmp_path / "f.csv"), NAMES)
    plain = got.select(*[F.regexp_replace(c, "\r\n", "\n").alias(c) for c in NAMES])
    assert sorted(map(repr, plain.collect())) == whole_file(spark, str(tmp_path / "f.csv"))


def test_a_record_of_many_ranges(spark, tmp_path, small_ranges):
    text = "line\n" * 500
    (tmp_path / "f.csv").write_text(f'h1,h2,h3\n1,"{text}",x\n\n2,b,"c\n"\n')
    got = feeds.read_feed(spark, str(tmp_path / "f.csv"), NAMES)
    assert rows(got) == [("1", text, "x"), ("2", "b", "c\n")]


def test_a_header_over_lines_and_an_empty_file(spark, tmp_path, small_ranges):
    (tmp_path / "f.csv").write_text('"h\n1",h2\na,b\n')
    assert rows(feeds.read_feed(spark, str(tmp_path / "f.csv"), ["h\n1", "h2"])) == [("a", "b")]
    (tmp_path / "g.csv").write_text("")
    assert read_records(spark, str(tmp_path / "g.csv")).count() == 0


def test_malformed_records_are_rejected(spark, tmp_path, small_ranges):
    good = "".join(f'{i},"two\nlines"\n' for i in range(100))
    (tmp_path / "f.csv").write_text(f'k,v\n{good}100,few,many\n101\nx,y\n102,"never closed\n{"tail " * 200}\n')
    schema = T.StructType.fromDDL("k bigint, v string")
    loaded, rejected = feeds.copy_csv(spark, str(tmp_path / "f.csv"), schema)
    assert rows(loaded) == sorted(((i, "two\nlines") for i in range(100)), key=str)
    found = rejected.select("k", F.col("reject_reasons")[0].alias("reason")).collect()
    assert sorted((r["k"], r["reason"]) for r in found) == [
        ("100", "number of fields or quotes"), ("101", "number of fields or quotes"),
        ("102", "number of fields or quotes"), ("x", "k does not convert"),
    ]
    (tmp_path / "g.csv").write_text("v,k\n1,2\n")
    with pytest.raises(ValueError):
        feeds.copy_csv(spark, str(tmp_path / "g.csv"), schema)


@pytest.mark.parametrize(
    "line, fresh, inside",
    [(b"", False, True), (b"a,b", False, True), (b'a,"b', True, False), (b'"a"', False, False), (b'x"y', False, False),
     (b'"a""', True, False), (b'"a""b",c', False, False), (b'",', True, False), (b'a",b,"c', True, True), (b'""', False, True)],
)
def test_states_of_a_line(line, fresh, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (fresh, inside)
