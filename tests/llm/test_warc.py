import base64
import hashlib

from lexivec.llm import queries, warc
from lexivec.llm.common import fresh_dir


def brute(rows):
    most = {}
    for i, _, html in rows:
        if i is not None:
            most[html or ""] = max(most.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = most.get(html or "")
        again = to is not None and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_pages(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op3_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute(rows)


def test_edge_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "http://a/ü\r\nX: y", ""), (3, "u", "é\r\n\r\nWARC/1.1"), (4, "u", "é\r\n\r\nWARC/1.1"), (5, "u", "x" * 300_000), (None, "u", "é\r\n\r\nWARC/1.1"), (6, "u", "only")]
    spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op3_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    where = fresh_dir(spark, "warc")
    index = warc.write(pages, where)
    some = warc.read(index.where("id in (3, 5)"), where).collect()
    assert {(r.id, bytes(r.payload or b"") or None) for r in some} == {(3, None), (5, b"x" * 300_000)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 500, 10), ("b", 0, 5), ("b", 6, 100)]
    assert warc.ranges(rows, gap=100, most=50) == [("a", 0, 20, [0, 1]), ("a", 500, 510, [2]), ("b", 0, 5, [3]), ("b", 6, 106, [4])]
