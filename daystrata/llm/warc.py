"""Web archive captures: "not modified" revisits are resolved to the response that they confirm.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.operators.prefix import with_bucket

# Header fields of a 304 response that replace the stored ones (RFC 9110, 15.4.5), and query parameters that
# only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|gclid|fbclid|sessionid|phpsessionid|ref)(=.*)?$"
#: Captures of a stretch of time, about; a URL's captures within one stretch are ordered in one task.
STRETCH_ROWS = 1_000_000


def canonical(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and last slash; host in small letters, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def strong(etag: Column) -> Column:
    """Entity tags are compared weakly: without the W/ mark."""
    return F.regexp_replace(etag, r"^W/", "")


def header_text(headers: Column) -> Column:
    """``name: value`` lines by name."""
    return F.array_join(F.transform(F.array_sort(headers), lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")


def merged(stored: Column, fresh: Column) -> Column:
    """The stored header fields with those of the 304 that it may change."""
    allowed = F.filter(fresh, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def resolve(captures: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """For every revisit, the latest earlier full response of its canonical URL, if the validators agree.

    ``captures``: ``record_id, url, at`` (microseconds), ``type`` (response or revisit), ``etag, last_modified, headers``
    (array of name and value), ``digest``. Returns ``record_id, canonical_url, at, outcome, response_id, digest, headers``:
    ``outcome`` is resolved (entity tags agree; without one, the dates do), unvalidated (the revisit has neither; the URL
    decides), mismatch or missing (no earlier response); the last two have no response. Headers are merged.

    Responses of one moment count by the largest record_id, a response at the revisit's own moment is not earlier. Rows
    without url or time cannot be placed: as revisits they are missing, as responses they are left out. Repeated rows
    repeat. A URL may have a third of all captures: time is cut into stretches, the last response of each stretch is
    carried to the next ones, and only (url, stretch) is ordered in one task.
    """
    answer = F.when(F.col("type") == "response", F.struct("at", "record_id", "etag", "last_modified", "headers", "digest"))
    rows = captures.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), F.col("at").cast("bigint").alias("at"), "type", "etag", "last_modified",
        F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"), "digest")
    rows = rows.withColumn("answer", answer)
    placed = rows.filter(F.col("canonical_url").isNotNull() & F.col("at").isNotNull())
    stretches = -(-placed.count() // stretch_rows)
    if stretches > 1:
        placed = with_bucket(placed.withColumn("_at", F.col("at").cast("double")), "_at", out="_stretch", buckets=stretches).drop("_at")
        last = placed.groupBy("canonical_url", "_stretch").agg(F.max("answer").alias("last"))
        past = Window.partitionBy("canonical_url").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("canonical_url", "_stretch", F.max("last").over(past).alias("carried"))
        placed = placed.join(carried, ["canonical_url", "_stretch"])
    else:
        placed = placed.withColumns({"_stretch": F.lit(0.0), "carried": F.lit(None).cast(placed.schema["answer"].dataType)})
    past = Window.partitionBy("canonical_url", "_stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("found", F.coalesce(F.max("answer").over(past), "carried"))
    lost = rows.filter(F.col("canonical_url").isNull() | F.col("at").isNull()).withColumn("found", F.lit(None).cast(rows.schema["answer"].dataType))
    columns = ["record_id", "canonical_url", "at", "type", "etag", "last_modified", "headers", "found"]
    asked = placed.select(*columns).union(lost.select(*columns)).filter(F.col("type") == "revisit")
    agree = F.coalesce(strong(F.col("etag")) == strong(F.col("found.etag")), F.lit(False))
    same = F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False))
    outcome = (F.when(F.col("found").isNull(), "missing").when(F.col("etag").isNotNull(), F.when(agree, "resolved").otherwise("mismatch"))
               .when(F.col("last_modified").isNotNull(), F.when(same, "resolved").otherwise("mismatch")).otherwise("unvalidated"))
    asked = asked.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unvalidated")
    return asked.select("record_id", "canonical_url", "at", "outcome", F.when(good, F.col("found.record_id")).alias("response_id"),
                        F.when(good, F.col("found.digest")).alias("digest"),
                        F.when(good, merged(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))
