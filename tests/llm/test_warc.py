import random

import pytest
from pyspark.sql import functions as F

from daystrata.llm import warc as w

SCHEMA = ("record_id long, url string, at long, type string, etag string, last_modified string,"
          " headers array<struct<name:string,value:string>>, digest string, extra string")


def test_canonical(spark):
    same = ["http://www.Example.com:80/a/b/?b=2&a=1&utm_source=x#frag", "https://example.com/a/b?a=1&b=2", " https://WWW2.example.com:443/a/b//?gclid=3&b=2&a=1"]
    frame = spark.createDataFrame([(u,) for u in [*same, "http://example.com", "https://example.com/?", "http://example.com/A", "", None]], "url string")
    got = [r[0] for r in frame.select(w.canonical(F.col("url"))).collect()]
    assert set(got[:3]) == {"example.com/a/b?a=1&b=2"} and got[3:] == ["example.com", "example.com", "example.com/A", "", None]


def brute(rows):
    out = []
    for rid, url, at, kind, etag, date, headers, _, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and None not in (url, at, r[1], r[2]) and r[1] == url and r[2] < at]
        found = max(earlier, key=lambda r: (r[2], r[0] if r[0] is not None else -1), default=None)
        if found is None:
            outcome = "missing"
        elif etag is not None:
            outcome = "resolved" if found[4] is not None and etag.removeprefix("W/") == found[4].removeprefix("W/") else "mismatch"
        elif date is not None:
            outcome = "resolved" if found[5] == date else "mismatch"
        else:
            outcome = "unvalidated"
        mine = dict(headers or [])
        if outcome in ("resolved", "unvalidated"):
            new = {k: v for k, v in mine.items() if k.lower() in w.PERMITTED}
            held = {k: v for k, v in (found[6] or []) if k.lower() not in {x.lower() for x in new}}
            out.append((rid, url, at, outcome, found[0], found[7], sorted({**held, **new}.items())))
        else:
            out.append((rid, url, at, outcome, None, None, sorted(mine.items())))
    return out


@pytest.mark.parametrize("stretch", [1_000_000, 40])
def test_resolution_equals_brute_force(spark, stretch):
    rng = random.Random(8)
    tags, dates = ['"a"', 'W/"a"', '"b"', None], ["d1", "d2", None]
    fields = lambda: rng.choice([None, [], [("Date", "x"), ("X-Cache", "HIT")], [("date", "y"), ("ETag", '"a"'), ("Content-Length", "0")],
                                 [("Content-Length", "9"), ("Cache-Control", "no")]])
    rows = [(i, rng.choice(["h/hot"] * 6 + ["h/a", "h/b", None]), rng.choice([None, *range(0, 60)]) if i % 9 == 0 else rng.randrange(400),
             rng.choice(["response", "revisit", "revisit", "metadata", None]), rng.choice(tags), rng.choice(dates), fields(), f"x{i}", "e") for i in range(500)]
    rows += [rows[3], rows[3], (None, "h/a", 7, "response", '"a"', None, None, "none", "e")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "found").repartition(4)
    got = [(r.record_id, r.canonical_url, r.at, r.outcome, r.response_id, r.digest, sorted((h.name, h.value) for h in r.headers))
           for r in w.resolve(frame, stretch).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert w.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
