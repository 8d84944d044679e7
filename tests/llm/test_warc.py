import datetime
import gzip
import hashlib
import io

from ledgerglass.llm import warc


def expected(rows, least):
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            top[b] = max(top.get(b, i), i)
    out = set()
    for i, _, h in rows:
        b = (h or "").encode()
        t = top.get(b)
        again = t is not None and t != i
        out.add((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", t if again else None))
    return out


def test_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "é" * 600), (2, "http://b/", "é" * 600), (3, None, None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (6, "u", "short"), (7, "u", "short"), (None, "u", "é" * 600), (9, "u", "z" * 400000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert len(got) == len(rows) and set(got) == expected(rows, 1000)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pushdown_and_skipping(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/{i}", f"page {i // 2} " * 300) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(warc.deduplicated(pages), path)
    df = warc.read(spark, path)
    some = df.where("record_type = 'revisit' and target_uri like 'http://h1/%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.split("Filter")[-1] if "Filter" in plan else True
    assert {r.target_uri for r in some.collect()} == {u for i, u, _ in rows if i % 2 == 0 and "h1/" in u}
    light = warc.read(spark, path, payload=False)
    assert light.where("payload is not null").count() == 0
    assert {(r.record_id, r.payload_bytes) for r in light.collect()} == {(f"urn:x-page:{i}", len(h)) for i, _, h in rows}


def test_foreign_archives():
    made = [warc.record("response", f"r{i}", b"x" * (i * 50000), "00" * 20, "2020-01-01T00:00:00Z") for i in range(4)]
    for data in (b"".join(made), b"".join(gzip.compress(m) for m in made), b"".join(warc.member(m) for m in made)):
        got = list(warc.read_records(io.BytesIO(data)))
        assert [h["warc-record-id"] for h, _ in got] == ["<r0>", "<r1>", "<r2>", "<r3>"]
        assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in got] == [0, 50000, 100000, 150000]
        only = list(warc.read_records(io.BytesIO(data), lambda h: h["warc-record-id"] == "<r2>", payload=False))
        assert len(only) == 1 and only[0][1].endswith(b"\r\n\r\n")
    assert gzip.decompress(b"".join(warc.member(m) for m in made)) == b"".join(made)


def test_ids_of_any_kind(spark):
    """Strings with colons, spaces, line breaks, empty and null ones; columns whose names are used inside; repeated rows."""
    rows = [("a:b", "u", "x" * 2000), ("", "u", "y" * 2000), (None, "u", "x" * 2000), ("é %41+ /\r\n", "u", "y" * 2000), ("a:b", "u", "x" * 2000), ("z z", "u", None)]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id string, url string, html string, payload string, first_id int")
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert len(got) == len(rows) and set(got) == expected(rows, 1000)
    days = [(datetime.date(2024, 1, i + 1), "u", "w" * 1500) for i in range(3)]
    got = {tuple(r) for r in warc.round_trip(spark.createDataFrame(days, "page_id date, url string, html string")).collect()}
    assert got == expected(days, 1000)
