"""Revisit records that say "not modified", resolved against earlier full responses.

Records are captures of URLs: full responses and revisits.  A revisit looks up the
latest response of the same canonical URL that is strictly earlier.  If its
validators agree (entity tag first, compared weakly; else the date of last
change; else the payload's digest), it stands for that response, whose headers are
merged with those of the revisit that a 304 may update.

The captures are written once.  What counts of a URL at one moment is its last
response there, so captures become at most one row for each URL and time before they are
joined, however many bear one time.  The as-of join keeps no URL's times in one place: they are
cut into buckets that hold a like number of rows, each URL's last response of a
bucket is carried to its later buckets, and within (URL, bucket) a window does the
rest.  A URL with a third of all captures so spreads over a third of all
buckets.  Revisits of one URL and time are dealt among tasks when they get what was found.

Outcomes: ``match``, ``mismatch`` (validators differ), ``no_validator`` (nothing
to compare), ``no_base`` (no earlier response; a null or empty URL or a null
time never has one).  Of responses at one time the larger record id counts.
Names of headers that differ in case alone are one header, its values joined by ", " in the order of
their spellings; null headers count as none.  Repeated revisit rows are resolved each.  An
empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselite.llm._util import materialise, spread_join

#: Query parameters that don't change what a URL names.
TRACKING = r"(?i)^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)"
#: Headers of a stored response that a 304 can't update (fixed by RFC 9111 and RFC 9110).
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "trailer", "upgrade", "te", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection")
#: Captures of one bucket of time.
BUCKET_ROWS = 100_000
#: Bounds of the number of buckets; even a URL with all times is cut into as many windows, which spill.
LEAST_BUCKETS = 16
MOST_BUCKETS = 4096


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slashes, sorted parameters without
    those that only track; no scheme and no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def opaque(tag: Column) -> Column:
    """An entity tag without its mark of weakness."""
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def _lower_names(headers: Column) -> Column:
    """The headers by lower-case names; of names that differ in case alone the values are joined."""
    names = F.transform(F.map_keys(headers), F.lower)
    once = F.array_distinct(names)
    entries = F.array_sort(F.map_entries(headers))
    given = F.transform(once, lambda n: F.transform(F.filter(entries, lambda e: (F.lower(e["key"]) == n) & e["value"].isNotNull()), lambda e: e["value"]))
    values = F.transform(given, lambda v: F.when(F.size(v) > 0, F.array_join(v, ", ")))
    plain = F.when(F.size(once) == F.size(names), F.map_from_arrays(names, F.map_values(headers))).otherwise(F.map_from_arrays(once, values))
    return F.when(headers.isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(plain)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated and completed by those of a 304 that may; names in lower case."""
    may = F.map_filter(_lower_names(fresh), lambda k, v: ~k.isin(*KEPT_HEADERS))
    stays = F.map_filter(_lower_names(stored), lambda k, v: ~F.map_contains_key(may, k))
    return F.map_concat(stays, may)


def _below(edges: list[int], at: Column) -> Column:
    """How many of the ascending edges lie below: among every n-th, then among the n behind the last of those that do."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    count = lambda found: F.aggregate(found, F.lit(0), lambda n, e: n + F.when(e < at, 1).otherwise(0))
    array = lambda values: F.array(*[F.lit(int(e)).cast("long") for e in values])
    coarse = F.greatest(count(array(edges[::step])) - 1, F.lit(0)) * step
    return coarse + count(F.slice(array(edges), coarse + 1, F.lit(step)))


def resolve(captures: DataFrame, buckets: int | None = None) -> DataFrame:
    """A row for each revisit of ``captures`` (record_id long, url string, at long, kind 'response' or 'revisit', etag,
    last_modified and digest string, headers map): record_id, base_id, outcome, headers."""
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("key"), F.col("at").cast("long").alias("at"), "kind", "etag", "last_modified", "digest", "headers")
    rows = materialise(rows, "captures")
    is_named = (F.coalesce(F.col("key"), F.lit("")) != "") & F.col("at").isNotNull()
    named = rows.filter(is_named)
    # one aggregate gives the number of rows and as many edges as there may be buckets
    n, edges = named.agg(F.count("*"), F.percentile_approx("at", [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)], 10 * MOST_BUCKETS)).first()
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n // BUCKET_ROWS)))
    chosen = sorted({edges[i * MOST_BUCKETS // buckets - 1] for i in range(1, buckets)}) if edges else []
    info = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    is_response, asks = F.col("kind") == "response", F.col("kind") == "revisit"
    points = named.groupBy("key", "at").agg(F.max_by(F.when(is_response, info), F.when(is_response, F.col("record_id"))).alias("info"), F.max(asks).alias("asks"))
    placed = materialise(points.withColumn("bucket", _below(chosen, F.col("at"))), "points")
    there = F.col("info").isNotNull()
    # as many rows for a URL as there are buckets at most
    last = placed.groupBy("key", "bucket").agg(F.max_by(F.when(there, F.col("info")), F.when(there, F.col("at"))).alias("last"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy("key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("here", F.last("info", ignorenulls=True).over(within)).filter("asks")
    found = seen.join(carried, ["key", "bucket"]).select("key", "at", F.coalesce("here", "carried").alias("base"))
    revisits = rows.filter(asks)
    met = spread_join(revisits.filter(is_named), found, ["key", "at"], F.monotonically_increasing_id())
    alone = revisits.filter(~is_named).withColumn("base", F.lit(None).cast(met.schema["base"].dataType))
    columns = ["record_id", "etag", "last_modified", "digest", "headers", "base"]
    both = met.select(*columns).unionByName(alone.select(*columns))
    base = F.col("base")
    agree = (
        F.when(base.isNull(), "no_base")
        .when(F.col("etag").isNotNull() & base["etag"].isNotNull(), F.when(opaque(F.col("etag")) == opaque(base["etag"]), "match").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & base["last_modified"].isNotNull(), F.when(F.col("last_modified") == base["last_modified"], "match").otherwise("mismatch"))
        .when(F.col("digest").isNotNull() & base["digest"].isNotNull(), F.when(F.col("digest") == base["digest"], "match").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    return both.withColumn("outcome", agree).select("record_id", base["record_id"].alias("base_id"), "outcome", F.when(F.col("outcome") == "match", merged_headers(base["headers"], F.col("headers"))).alias("headers"))
