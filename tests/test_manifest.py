"""Loads that end all at once or not at all."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import AS_OF, DATA, rows
from pyspark.sql import functions as F

from tallybook import pipeline
from tallybook.bindings import raw_feeds
from tallybook.pipeline import load_all
from tallybook.plans import summaries
from tallybook.sources import manifest, tables


@pytest.fixture
def two_loads(spark):
    raw = raw_feeds(spark, f"{DATA}/sf0.001")
    early = raw["transactions"].filter("timestamp < '2024-01-22'")
    late = raw["transactions"].filter("timestamp >= '2024-01-08'")
    return {**raw, "transactions": early}, {**raw, "transactions": late}


def content(star) -> dict:
    return {name: rows(df.drop("created_at", "updated_at")) for name, df in star.tables().items()}


def test_a_load_that_dies_leaves_the_old_star(spark, tmp_path, monkeypatch, two_loads):
    root = str(tmp_path / "w")
    first, rejects = load_all(spark, two_loads[0], root, AS_OF, now=F.lit("2024-02-01").cast("timestamp_ntz"))
    before, lost = content(first), {n: df.count() for n, df in rejects.items()}

    def dies(*_, **__):
        raise RuntimeError("killed")

    for step in ("write_fact", "merge_parts", "commit"):
        with monkeypatch.context() as patched:
            patched.setattr(pipeline, step, dies)
            with pytest.raises(RuntimeError, match="killed"):
                load_all(spark, two_loads[1], root, AS_OF, mode="append")
        assert manifest.listing(spark, root).version == 1
    assert content(tables.read_star(spark, root)) == before

    star, rejects = load_all(spark, two_loads[1], root, AS_OF, now=F.lit("2024-02-02").cast("timestamp_ntz"), mode="append")
    twice = sum(20240108 <= r["date_id"] <= 20240121 for r in first.sales.collect())
    assert twice and rejects["fact_sales"].count() == lost["fact_sales"] + twice
    assert rows(star.daily.drop("created_at", "updated_at")) == rows(summaries.daily_sales_summary(star.sales))
    assert rows(star.book_performance.drop("created_at", "updated_at")) == rows(summaries.book_performance(star.sales, star.dates))
    # A day of the first load alone keeps its stamp.
    stamps = {r["date_id"]: str(r["updated_at"])[:10] for r in star.daily.collect()}
    assert stamps[min(stamps)] == "2024-02-01" and stamps[max(stamps)] == "2024-02-02"

    # What died is removed, what is listed stays.
    content_now = content(star)
    assert len(list(Path(root).glob("fact_sales/load=*"))) == 4
    assert manifest.drop_unlisted(spark, root, keep=0)
    assert len(list(Path(root).glob("fact_sales/load=*"))) == 2
    assert content(tables.read_star(spark, root)) == content_now
    assert manifest.versions(spark, root) == [2] and manifest.drop_unlisted(spark, root, keep=0) == []


def test_of_two_loads_from_one_version_one_fails(spark, tmp_path):
    root, start = str(tmp_path), manifest.Listing()
    manifest.commit(spark, root, start, {"t": ["load=a"]})
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        manifest.commit(spark, root, start, {"t": ["load=b"]})
    assert manifest.listing(spark, root).tables == {"t": ["load=a"]}


def test_an_unfinished_list_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    manifest.commit(spark, root, manifest.Listing(), {"t": ["load=a"]})
    (tmp_path / "manifest/v00000002").mkdir()
    assert manifest.listing(spark, root).version == 1


def test_append_to_a_star_without_a_list(spark, tmp_path, events, two_loads):
    tables.create_star(events, str(tmp_path))
    with pytest.raises(ValueError):
        load_all(spark, two_loads[0], str(tmp_path), AS_OF, mode="append")


def test_parts_that_are_not_touched_keep_their_files(spark, tmp_path):
    root, part = str(tmp_path), "k DIV 10"
    table = lambda *rows_: spark.createDataFrame(rows_, "k bigint, v string")
    first = manifest.merge_parts(spark, root, "t", [], table((1, "a"), (11, "b"), (21, "c"), (22, "d")), "k", part)
    second = manifest.merge_parts(spark, root, "t", first, table((12, "x"), (21, "y"), (31, "z")), "k", part)
    assert [p.rpartition("/")[2] for p in sorted(set(first) & set(second))] == ["part=0"]
    assert rows(manifest.read_table(spark, root, "t", second), "k", "v") == [(1, "a"), (11, "b"), (12, "x"), (21, "y"), (22, "d"), (31, "z")]
    assert manifest.merge_parts(spark, root, "t", second, table().limit(0), "k", part) == second


def test_a_load_without_rows(spark, tmp_path, two_loads):
    nothing = {k: df.limit(0) for k, df in two_loads[0].items()}
    star, rejects = load_all(spark, nothing, str(tmp_path / "w"), AS_OF)
    assert [star.sales.count(), star.users.count(), star.daily.count(), rejects["fact_sales"].count()] == [0, 0, 0, 0]
    again, _ = load_all(spark, two_loads[0], str(tmp_path / "w"), AS_OF, mode="append")
    assert again.sales.count() > 0 and again.daily.count() > 0
