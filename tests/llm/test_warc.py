"""Archives against the rule written plainly, whatever payloads hold."""

import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from threadloom.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.StringType())])
PAYLOADS = [
    None, "", "plain", "plain", "tail\r\n", "tail\r\n", "tail\r", "\r\n\r\n", "a\r\n\r\nb\r\n\r\n", "\r\n", "x\r\n\r", "x\r\n\r\n\r\n",
    "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello", "ünïcode 漢字 \x00", "\r\n\r\n" * 5000, "long " * 300_000, "plain", "\n\n", "\r\r\n\r\n",
]
ROWS = [(i * 3 % 19, f"http://a.example/{i}\r\nX: 1" if i % 4 else None, p) for i, p in enumerate(PAYLOADS)] + [(7, "u", "tail\r\n"), (None, "v", "plain"), (None, "v", "lonely"), (None, "w", "lonely")]


def pages(spark, rows=ROWS, partitions=3):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA).repartition(partitions)


def plainly(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row, sorted."""
    smallest = {}
    for i, _, p in rows:
        if i is not None:
            smallest[p or ""] = min(i, smallest.get(p or "", i))
    out = []
    for i, _, p in rows:
        body = (p or "").encode()
        first = smallest.get(p or "") if len(body) >= least else None
        again = first is not None and first != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_the_rule(spark, partitions):
    assert rows_of(warc.archives_digest(pages(spark, partitions=partitions))) == plainly(ROWS)


def test_given_pages_equal_the_rule(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    assert rows_of(warc.archives_digest(table)) == plainly(rows)


def test_payloads_come_back_once_and_small_ones_each_time(spark, tmp_path):
    found = warc.deduplicated(pages(spark), f"file://{tmp_path}/a", least_bytes=6)
    assert rows_of(found) == plainly(ROWS, 6)
    back = {(r.page_id, bytes(r.payload)) for r in found.collect() if r.record_type == "response"}
    assert back == {(i, (p or "").encode()) for i, _, p in ROWS if (i, len((p or "").encode()), "response") in {x[:2] + x[3:4] for x in plainly(ROWS, 6)}}
    assert all(r.payload is None for r in found.filter("record_type = 'revisit'").collect())


def test_archives_are_plain_warc_files(spark, tmp_path):
    """Parsed by lengths alone: each header has its fields, and nothing of a url can add one."""
    warc.deduplicated(pages(spark), f"file://{tmp_path}/a")
    seen = 0
    for name in glob.glob(f"{tmp_path}/a/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            need = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and b"X" not in fields and data[need : need + 4] == b"\r\n\r\n"
            assert (b"WARC-Refers-To" in fields) == (fields[b"WARC-Type"] == b"revisit")
            data, seen = data[need + 4 :], seen + 1
    assert seen == len(ROWS)


def test_rewriting_joins_old_revisits_to_responses(spark, tmp_path):
    """Two archives of halves, rewritten as one: old revisits stay so, and responses meet across archives."""
    half = len(ROWS) // 2
    for i, rows in enumerate((ROWS[:half], ROWS[half:])):
        warc.deduplicated(pages(spark, rows), f"file://{tmp_path}/old/half={i}")
    found = warc.rewritten(spark, f"file://{tmp_path}/old/*", f"file://{tmp_path}/new")
    rows = rows_of(found)
    assert [r[:3] for r in rows] == [r[:3] for r in plainly(ROWS)]
    held = {(r[0], r[2]) for r in rows if r[3] == "response"}
    assert all((r[4], r[2]) in held for r in rows if r[3] == "revisit")


def test_a_changed_archive_is_refused(spark, tmp_path):
    warc.deduplicated(pages(spark, ROWS[2:3], 1), f"file://{tmp_path}/a")
    name = next(x for x in glob.glob(f"{tmp_path}/a/*.gz") if b"plain" in gzip.open(x).read())
    data = gzip.open(name).read()
    (tmp_path / "b").mkdir()
    with gzip.open(tmp_path / "b" / "x.gz", "wb") as file:
        file.write(data.replace(b"plain\r", b"plane\r"))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, f"file://{tmp_path}/b").collect()


def test_empty_table(spark):
    assert warc.archives_digest(pages(spark, [])).collect() == []


def test_a_list_too_large_to_broadcast_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("threadloom.shared.BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "size_checked", lambda table, *_: table.hint("merge"))
    assert rows_of(warc.archives_digest(pages(spark))) == plainly(ROWS)
