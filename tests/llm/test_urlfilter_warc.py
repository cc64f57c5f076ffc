import hashlib
import random
from collections import Counter

import duckdb
import pytest
from colloquy.llm import urlfilter, warc

URLS = [
    None, "", "no scheme", "http://", "http://a.ORG", "http://a.ORG/", "https://example.org/es/x?y#z", "http://x.y.example.org/es/", "http://example.org/en/12#t", "http://example.org?/es/",
    "http://xexample.org/es/", "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/it/", "ftp://c.net/a://b/", "http://org/es/", "http://.org/", "http://a..org/x", "http://org./x", "http://ümlaut.com/de/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    k = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:k])
    path = rest[k:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("ranges", [1, 5])
def test_contract_rules(spark, ranges):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(6, URLS[6]), (None, URLS[6])], "page_id long, url string")
    got = Counter(tuple(r) for r in urlfilter.match_rules(df, urlfilter.contract_rules(spark), ranges=ranges).select("page_id", "host", "path", "rule", "verdict").collect())
    want = Counter((i, *brute(u, urlfilter.RULES)) for i, u in [*enumerate(URLS), (6, URLS[6]), (None, URLS[6])])
    assert got == want


def test_many_nested_rules(spark):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice(["x", "y"]) for _ in range(rng.randrange(0, 4)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(400)] + ["http://a.b/x"] * 300
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.match_rules(df, spark.createDataFrame(rules, "verdict string, host string, path string"), ranges=7).collect()}
    assert got == {i: brute(u, rules)[3] for i, u in enumerate(urls)}


def test_url_query_equals_sql_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    q = urlfilter.op10_url_filter(spark, str(tmp_path))
    assert Counter(map(tuple, q.collect())) == Counter(con.execute(f"select {', '.join(q.columns)} from ({urlfilter.OP10_SQL})").fetchall())
    assert urlfilter.match_rules(df.limit(0), urlfilter.contract_rules(spark)).count() == 0
    assert {r["verdict"] for r in urlfilter.match_rules(df, urlfilter.contract_rules(spark).limit(0)).collect()} == {"allow"}


def pages(spark):
    long, short = "<p>é" * 400, "<p>"
    rows = [(1, "http://a/\r\nx", long), (2, "u", long), (7, None, long), (3, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (8, "u", "z" * 1000), (9, "u", "z" * 999), (10, "u", "z" * 999), (7, None, long), (None, "u", long), (None, "u", "y" * 2000), (-4, "u", "y" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark, tmp_path):
    df = pages(spark)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    q = warc.op5_warc_archive(spark, str(tmp_path))
    assert Counter(map(tuple, q.collect())) == Counter(con.execute(f"select {', '.join(q.columns)} from ({warc.OP5_SQL})").fetchall())
    archive = warc.write_archive(df)
    assert archive.payloads.count() == len({r["html"] or "" for r in df.collect()})
    by = {(r["page_id"]): r for r in warc.read_archive(archive).collect()}
    record = bytes(by[7]["record"])
    head, body = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == ("<p>é" * 400).encode() + b"\r\n\r\n"
    assert f"Content-Length: {len(body) - 4}".encode() in head and hashlib.sha1(body[:-4]).hexdigest().encode() in head
    assert by[1]["refers_to"] == 7 and bytes(by[1]["record"]).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0


def test_altered_payload_is_noticed(spark):
    from pyspark.sql import functions as F

    archive = warc.write_archive(pages(spark))
    changed = warc.Archive(archive.payloads.withColumn("payload", F.concat("payload", F.lit("x").cast("binary"))), archive.headers)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(changed).collect()


def test_odd_urls_and_a_payload_of_a_third_of_all_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_TOGETHER", 7)
    urls = ["u\u2028WARC-Payload-Digest: sha1:zz", "u\u0085WARC-Refers-To: <urn:page:9>", "u\u2029WARC-Type: revisit", "u\r\nWARC-Type: revisit", "WARC-Type: revisit\r\n\r\n", None]
    bodies = ["hot" * 500, "a\r\n\r\nb" * 200, "\u2028\u0085\r\nWARC-Type: revisit\r\n\r\n"]
    rows = [(i, urls[i % len(urls)], bodies[0] if i % 3 == 0 else bodies[i % 3] + str(i % 5) * (i % 2)) for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    q = warc.op5_warc_archive(spark, str(tmp_path))
    assert Counter(map(tuple, q.collect())) == Counter(con.execute(f"select {', '.join(q.columns)} from ({warc.OP5_SQL})").fetchall())
    payload = {i: (h or "").encode() for i, _, h in rows}
    for r in warc.read_archive(warc.write_archive(spark.read.parquet(f"{tmp_path}/pages.parquet"))).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert body == (payload[r["page_id"]] if r["record_type"] == "response" else b"") + b"\r\n\r\n"
        assert head.count(b"\r\n") == 7 + (r["record_type"] == "revisit")
