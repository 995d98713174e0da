import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from orbweave.llm import page_captures, warc

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "record_id string, kind string, url string, at timestamp, headers map<string,string>, matched string"


def row(record, kind, url, minute, **headers):
    return (record, kind, url, None if minute is None else T0 + datetime.timedelta(minutes=minute), {k.replace("_", "-"): v for k, v in headers.items()}, "clash")


def test_canonical(spark):
    urls = ["HTTP://user@WWW.Example.com:80/a//?b=2&utm_source=x&a=1#f", "https://example.com/a/?a=1&b=2&ref=z", "http://h/", "http://h", "nonsense", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.canonical(F.col("url")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got[:4] == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "h", "h"]


def test_resolve(spark):
    rows = [
        row("f1", "response", "http://h/x", 0, ETag='"1"', Server="s", Set_Cookie="a"),
        row("f2", "response", "http://www.h/x/", 10, etag='"2"', last_modified="m2"),
        row("r0", "revisit", "http://h/x", 0, etag='"1"'),
        row("r1", "revisit", "http://h/x#a", 5, etag='W/"1"', cache_control="c", set_cookie="b", date="d"),
        row("r2", "revisit", "http://h/x", 10, etag='"1"'),
        row("r3", "revisit", "http://h/x", 11, etag='"1"'),
        row("r4", "revisit", "http://h/x", 12, last_modified="m2"),
        row("r5", "revisit", "http://h/x", 13),
        row("r6", "revisit", "http://other/", 13, etag='"1"'),
        row("r7", "revisit", None, 13, etag='"1"'),
        row("r8", "revisit", "http://h/x", None, etag='"1"'),
    ]
    df = spark.createDataFrame([*rows, rows[3]], SCHEMA)
    got = sorted(((r.record_id, r.outcome, r.matched, r.headers) for r in warc.resolve(df).collect()), key=lambda x: x[0])
    merged = {"etag": 'W/"1"', "server": "s", "set-cookie": "a", "cache-control": "c", "date": "d"}
    assert got == [
        ("r0", "missing", None, None), ("r1", "resolved", "f1", merged), ("r1", "resolved", "f1", merged), ("r2", "resolved", "f1", {"etag": '"1"', "server": "s", "set-cookie": "a"}),
        ("r3", "changed", "f2", None), ("r4", "resolved", "f2", {"etag": '"2"', "last-modified": "m2"}), ("r5", "unchecked", "f2", None),
        ("r6", "missing", None, None), ("r7", "missing", None, None), ("r8", "missing", None, None),
    ]
    assert warc.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("named", [True, False])
def test_a_url_over_many_tasks(spark, named):
    """One URL has nearly all captures, and responses are rare: most rows need what an earlier task saw. Also where responses have no record id."""
    rows = [row(f"f{k:05d}" if named else None, "response", f"http://h/{k % 4}", k * 1000, etag=f'"{k}"') for k in range(12)]
    rows += [row(f"r{k:05d}", "revisit", "http://h/1", k, etag=f'"{k // 4000 * 4 + 1}"') for k in range(0, 12_000, 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: (r.outcome, r.matched) for r in warc.resolve(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for k in range(0, 12_000, 7):
        last = max((x for x in (1, 5, 9) if x * 1000 < k), default=None)
        said = "missing" if last is None else "resolved" if last == k // 4000 * 4 + 1 else "changed"
        assert got[f"r{k:05d}"] == (said, None if last is None or not named else f"f{last:05d}"), k


def test_files(spark, tmp_path):
    one = warc.record("response", "<urn:1>", "http://h/a", "2024-01-01T00:00:00Z", "200 OK", {"ETag": '"x"', "Content-Type": "text/html"}, b"<p>\r\n\r\nWARC/1.0 body</p>")
    two = warc.record("revisit", "<urn:2>", "http://h/a", "2024-01-02T00:00:00Z", "304 Not Modified", {"ETag": '"x"'})
    other = warc.record("request", "<urn:3>", "http://h/a", "2024-01-02T00:00:00Z", "x", {})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(other) + gzip.compress(two))
    (tmp_path / "b.warc").write_bytes(one + two)
    got = warc.read(spark, str(tmp_path)).orderBy("record_id", "kind").collect()
    assert [(r.record_id, r.kind, r.status) for r in got] == [("<urn:1>", "response", 200)] * 2 + [("<urn:2>", "revisit", 304)] * 2
    assert got[0].payload == b"<p>\r\n\r\nWARC/1.0 body</p>"
    back = warc.resolve(warc.read(spark, str(tmp_path / "a.warc.gz"))).collect()
    assert [(r.record_id, r.outcome, r.matched) for r in back] == [("<urn:2>", "resolved", "<urn:1>")]


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/?x=1", "<p>"), (2, "http://a/?x=1#b", None), (3, None, "q")], "page_id long, url string, html string")
    got = {r.record_id: (r.outcome, r.matched) for r in page_captures.resolved(pages).collect()}
    assert got == {"revisit-1": ("changed", "page-2"), "revisit-2": ("resolved", "page-2"), "revisit-3": ("missing", None)}


def test_files_are_streamed(monkeypatch):
    """Records over many reads, one gzip member for all of them, and trailing noise."""
    import io

    monkeypatch.setattr(warc, "CHUNK", 37)
    body = bytes(range(256)) * 3 + b"WARC/1.0\r\n\r\n"
    data = b"".join(warc.record("response", f"<urn:{k}>", f"http://h/{k}", "2024-01-01T00:00:00Z", "200 OK", {"a": str(k)}, body * k) for k in range(6))
    for packed in (data, gzip.compress(data), b"".join(gzip.compress(data[a : a + 500]) for a in range(0, len(data), 500)), data + b"noise"):
        got = list(warc.parse(io.BytesIO(packed)))
        assert [(r["record_id"], r["payload"]) for r in got] == [(f"<urn:{k}>", body * k) for k in range(6)]
    assert list(warc.parse(io.BytesIO(b""))) == []
