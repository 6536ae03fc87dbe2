import hashlib
import random

from pyspark.sql import functions as F

from strataloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(seed):
    rnd = random.Random(seed)
    big = ["x" * 1000, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60, "é" * 600, "\r\n\r\n" * 400]
    out = [(i, rnd.choice([f"http://h/{i}", "http://a\r\nb", None]), rnd.choice([*big, "small", None, "", f"own {i} " * 200])) for i in range(200)]
    return out + [(None, "u", big[0]), (7, "u1", big[2]), (7, "u2", big[2]), (7, "u2", big[2]), (500, "http://long", "long <html>\n" * 100_000), (501, None, "x" * 999), (502, None, "x" * 999)]


def brute(rows):
    out, best = [], {}
    body = lambda r: (r[2] or "").encode()
    for r in rows:
        if len(body(r)) >= 1000:
            best[body(r)] = max(best.get(body(r), -1), -1 if r[0] is None else r[0])
    given = set()
    for r in sorted(rows, key=lambda r: r[1] or ""):
        b = body(r)
        original = best.get(b)
        first = original == r[0] and b not in given
        if first:
            given.add(b)
        revisit = original is not None and not first
        out.append((r[0], len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


def test_archives_read_back(spark, tmp_path):
    rows = pages(1)
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "nth": F.lit(2)}), path)
    out = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in out if r.record_type == "response")
    assert all(r.payload is None for r in out if r.record_type == "revisit")


def test_records_are_well_formed(spark, tmp_path):
    import gzip

    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame([(1, "http://a", "é" * 500), (2, "http://b", "é" * 500)], SCHEMA), str(path))
    data = b"".join(gzip.open(p).read() for p in sorted(path.glob("part-*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:uuid:" in data and data.count(b"\r\nContent-Length: ") == 3
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 1000\r\n\r\n"
    assert b"Content-Length: %d\r\n\r\n" % (len(head) + 1000) + head in data


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).collect() == []
