"""Odd rows that queries and their SQL must take alike."""

from __future__ import annotations

import os

from threadloom.plans import answers, found, registry  # noqa: F401

from .compare import rows_of, twin_rows


def folder_with(spark, tmp_path, **tables):
    small = "/root/testdata/sf0.001"
    for name in os.listdir(small):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{small}/{name}", tmp_path / name)
    for name, table in tables.items():
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def alike(spark, name, folder):
    rows = registry.QUERIES[name](spark, folder)
    columns, expected = twin_rows(registry.SQL[name], folder)
    assert sorted(rows.columns) == columns
    ours = rows_of(rows.columns, rows.collect())
    assert ours == expected
    return ours


def test_upper_case_of_letters_that_become_two(spark, tmp_path):
    messages = spark.createDataFrame([(2, 0, "user", "die Straße"), (2, 1, "user", "ŉ ﬁ"), (4, 5, "user", "ﬁ ß")], found.MESSAGES)
    assert alike(spark, "ingest_stream", folder_with(spark, tmp_path, conversations=messages))


def test_gold_in_the_plural_and_gold_without_a_fifth_word(spark, tmp_path):
    messages = spark.createDataFrame([(1, 0, "user", "the cats hold plans and dogs"), (11, 0, "user", "cat w houses z plan"), (21, 0, "user", "some bird is x fly")], found.MESSAGES)
    items = spark.createDataFrame([(1, "cats y plans x houses"), (11, "bird v fly")], "item_id long, text string")
    assert alike(spark, "near_claims", folder_with(spark, tmp_path, conversations=messages, benchmark=items)) == [("1", "1"), ("21", "11")]


def test_a_stream_of_changes_writes_no_row_for_each_context(spark, monkeypatch):
    seen = []
    run = found.jobs.run_once
    monkeypatch.setattr(found.jobs, "run_once", lambda stream, *rest: seen.append(stream.columns) or run(stream, *rest))
    rows = found.invalidation_stream(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["change_id", "context", "path"]
    assert seen == [["change_id", "path"]]
