"""Ingest into a table: replaced whole, idempotent, finished after a loss, nothing written where nothing changed."""

import os

import pytest

from threadloom.streaming import ingest, jobs

SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, folder):
    return ingest.Table(spark, f"file://{folder}/table", ingest.message_units(spark.createDataFrame([], SCHEMA))[0].schema)


def apply(spark, target, rows, name):
    target.apply(*ingest.message_units(spark.createDataFrame(rows, SCHEMA)), name)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/table/units") for f in names}


def rows(target):
    return sorted((r.owner, r.position, r.content, r.revision) for r in target.rows().collect())


def reports(target, name):
    return {r.change: (r.n, r.revision) for r in target.reports().filter(f"batch = '{name}'").collect()}


FIRST = [(c, t, "user", f"text {c} {t}") for c in range(8) for t in range(3)]


def test_whole_conversations_are_replaced(spark, tmp_path):
    target = table(spark, tmp_path)
    apply(spark, target, FIRST, "a")
    assert reports(target, "a") == {"added": (24, 1)}
    apply(spark, target, [(1, 0, "user", "text 1 0"), (1, 2, "user", "other"), (1, 5, "user", "more"), *[r for r in FIRST if r[0] == 2]], "b")
    assert reports(target, "b") == {"unchanged": (4, 2), "changed": (1, 2), "deleted": (1, 2), "added": (1, 2)}
    found = rows(target)
    assert [x[1:] for x in found if x[0] == "conversation:1"] == [(0, "text 1 0", 2), (2, "other", 2), (5, "more", 2)]
    assert {x[3] for x in found if x[0] != "conversation:1"} == {1} and len(found) == 24


def test_a_batch_run_twice_leaves_the_same_files(spark, tmp_path):
    target = table(spark, tmp_path)
    apply(spark, target, FIRST, "a")
    before = files(tmp_path)
    apply(spark, target, FIRST, "a")
    assert files(tmp_path) == before
    # Another batch that says the same writes no unit, and the revision stays.
    apply(spark, target, FIRST[:9], "c")
    assert files(tmp_path) == before and reports(target, "c") == {"unchanged": (9, 1)}


def test_a_batch_lost_half_way_is_finished(spark, tmp_path, monkeypatch):
    target = table(spark, tmp_path)
    apply(spark, target, FIRST, "a")
    changed = [(c, t, "user", "new") for c in range(4) for t in range(2)]
    deleted = []
    monkeypatch.setattr(ingest.Table, "_delete", lambda self, path: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        apply(spark, target, changed, "b")  # lost after the report: done
    monkeypatch.undo()
    done = rows(target)
    apply(spark, target, changed, "b")
    assert rows(target) == done and deleted == []
    # Lost before the overwrite: what was set aside is used, whatever the batch says when it is run again.
    other = table(spark, tmp_path / "x")
    apply(spark, other, FIRST, "a")
    units, refused = ingest.message_units(spark.createDataFrame(changed, SCHEMA))
    other._set_aside(units, refused, f"{other.path}/aside/batch=b")
    apply(spark, other, changed, "b")
    assert rows(other) == done and not os.path.exists(f"{tmp_path}/x/table/aside/batch=b")


def test_what_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_MESSAGES", 5)
    target = table(spark, tmp_path)
    bad = [(20, 0, "user", "x"), (20, 0, "user", "y"), (21, 0, "nobody", "x"), (22, 0, "user", None), (None, 0, "user", "x")] + [(23, t, "user", "x") for t in range(6)]
    apply(spark, target, FIRST + bad, "a")
    assert reports(target, "a") == {"added": (24, 1), "refused": (4, 1)} and len(rows(target)) == 24


def test_a_stream_in_batches_goes_on_from_its_folder(spark, tmp_path):
    target = table(spark, tmp_path)
    for i in range(3):
        spark.createDataFrame([(c, t, "user", f"v{i}") for c in (i, i + 1) for t in range(2)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    run = lambda: ingest.ingest(jobs.table_stream(spark, str(tmp_path), "conversations.parquet", SCHEMA, 1), ingest.message_units, target, "s", f"file://{tmp_path}/progress")
    run()
    assert {(x[0], x[2]) for x in rows(target)} == {("conversation:0", "v0"), ("conversation:1", "v1"), ("conversation:2", "v2"), ("conversation:3", "v2")}
    before = target.reports().select("batch").distinct().count()
    run()
    assert target.reports().select("batch").distinct().count() == before == 3
