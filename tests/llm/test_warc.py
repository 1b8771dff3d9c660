import gzip
import hashlib
import random

from lodestrata.llm.warc import CaptureIndex, archive_pages, capture_key, look_up, read_records, surt, write_and_read_back

SCHEMA = "page_id long, url string, html string, digest string, key int"


def pages():
    rng = random.Random(4)
    bodies = ["é" * 60, "x" * 99, "y" * 100, "", None, "<p>" + "z" * 500]
    rows = [(i, f"http://h{rng.randrange(5)}.example.com/{rng.randrange(9)} a?b={i % 3}", rng.choice(bodies)) for i in range(120)]
    rows += [(500, None, "w" * 300), (500, None, "w" * 300), (501, "nohost", "w" * 300), (None, "http://a.b/", "w" * 300), (502, "http://[bad/", "u" * 200)]
    return [(*r, "k", 1) for r in rows]


def brute(rows):
    first = {}
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        f = first.get(html)
        ref = f if f is not None and f != i else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    assert sorted(map(tuple, write_and_read_back(df).collect()), key=str) == brute(pages())


def test_empty(spark):
    assert write_and_read_back(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_blocks_and_archives(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    folder, index = archive_pages(df, f"file://{tmp_path}/w")
    small = CaptureIndex.build(spark.createDataFrame([(capture_key("http://a.b/", i // 4), "arch", i, 1) for i in range(50)], "key string, archive string, offset long, length long"), f"file://{tmp_path}/s", block_lines=3)
    assert len(small.directory) >= 16
    for i in range(12):
        assert [x[1] for x in small.find(capture_key("http://a.b/", i))] == list(range(4 * i, 4 * i + 4))
    assert small.find(capture_key("http://a.b/", 99)) == [] and small.find("") == []
    for f in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\n")
    one = spark.createDataFrame([(500, None), (7, "http://nowhere.example/")], "page_id long, url string")
    assert [r.page_id for r in read_records(index, look_up(index, one)).collect()] == [500, 500]


def test_surt():
    assert surt("https://u:p@WWW.a.Example:80/B?c=1#d") == "example,a,www)/B?c=1"
    assert surt("http://a.b") == "b,a)/" and surt(None) == "" and surt("x y") == "x y"
