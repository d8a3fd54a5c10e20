import hashlib

from netloom.llm import warc
from netloom.plans.scratch import written


def record(i, url, html):
    body = html or ""
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as volume", "'h' as hash")


def made():
    return [(i * 3, f"http://h/{i}", f"<p>é {i}</p>" * (i % 5)) for i in range(-20, 4000)] + [(1, None, None), (2, "", ""), (None, "u", "v"), (7, "u", "x" * 200000), (9, "twice", "a"), (9, "twice", "a")]


def test_records(spark):
    rows = [r for r in made() if r[0] is not None]
    out = warc.records(pages(spark, made())).collect()
    assert sorted((r["page_id"], r["length"], r["sha256"]) for r in out) == sorted((i, len(d), hashlib.sha256(d).hexdigest()) for i, d in ((r[0], record(*r)) for r in rows))
    by = {}
    for r in sorted(out, key=lambda r: (r["volume"], r["place"])):
        assert r["offset"] == by.get(r["volume"], 0)
        by[r["volume"]] = r["offset"] + r["length"]


def test_audit_finds_damage_and_nothing_else(spark):
    rows = made()
    bad = {r[0] for r in rows if r[0] is not None and r[0] % 97 == 5 and r[2]}
    p = pages(spark, rows)
    out = warc.check(p, warc.damaged(p)).collect()
    assert {r["page_id"] for r in out if r["corrupted"]} == bad and bad
    assert not [r for r in warc.check(p, p).collect() if r["corrupted"]]


def test_missing_records_and_empty_tables(spark):
    p = pages(spark, [(i, "u", f"{i}") for i in range(10)])
    first, second = written(warc.records(p)), written(warc.records(p.where("page_id < 9")))
    assert [tuple(r) for r in warc.audit(first, second).collect()] == [(0, 9)]
    none = pages(spark, [])
    assert warc.check(none, none).count() == 0
