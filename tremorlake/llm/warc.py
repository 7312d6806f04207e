"""Not-modified revisit records: each resolved to the latest earlier full response of its URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.llm.runtime import cut, shuffle_partitions

#: Headers that a not-modified answer may update in the stored response (fixed values, in lower case).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(c: Column) -> Column:
    return F.translate(c, _AZ, _AZ.lower())


def canonical_url(url: Column) -> Column:
    """The URL by which captures of one resource meet; null stays null.

    Scheme and host lower-cased, http taken as https, default ports and the fragment dropped,
    an empty path taken as `/`; path and query stay as they are. Without a scheme only the
    fragment goes.
    """
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)$"
    scheme, rest = _lower(F.regexp_extract(bare, pattern, 1)), F.regexp_extract(bare, pattern, 3)
    host = F.regexp_replace(_lower(F.regexp_extract(bare, pattern, 2)), r":(80|443)?$", "")
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    made = F.concat(F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), host, path)
    return F.when(scheme == "", bare).otherwise(made)


def _entries(headers: Column) -> Column:
    """Entries with a value, names in lower case; of names that differ in case only the first stays."""
    all_of = F.transform(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(_lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    held = F.filter(all_of, lambda e: e["value"].isNotNull())
    return F.filter(held, lambda e, i: F.array_position(F.transform(held, lambda x: x["key"]), e["key"]) == i + 1)


def normal_headers(headers: Column) -> Column:
    """The headers by lower-case name, sorted; a null map is empty."""
    return F.map_from_entries(F.array_sort(_entries(headers)))


def merged_headers(stored: Column, update: Column) -> Column:
    """Normal headers `stored` with those of `update` that a not-modified answer may change."""
    allowed = F.filter(F.map_entries(update), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(allowed, lambda e: e["key"])
    kept = F.filter(F.map_entries(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, allowed)))


def _outcome(stored: Column, update: Column, found: Column) -> Column:
    """Whether the validators of the revisit agree with the stored response."""
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), r"^W/", "")
    dated = lambda h: F.element_at(h, "last-modified")
    return (
        F.when(found.isNull(), "no_earlier_response")
        .when(tag(update).isNotNull() & tag(stored).isNotNull(), F.when(tag(update) == tag(stored), "resolved").otherwise("etag_differs"))
        .when(dated(update).isNotNull() & dated(stored).isNotNull(), F.when(dated(update) == dated(stored), "resolved").otherwise("date_differs"))
        .otherwise("no_common_validator")
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row for each revisit of `captures`: what it refers to, and the headers of the whole.

    `captures` has record_id long, url string, ts (any ordered type), kind string, status int,
    headers map<string,string>, digest string; further columns are ignored. A full response is
    a `response` with status 200, a url and a ts; the latest one of the same canonical URL with
    a smaller ts counts, of several at one ts that with the largest record_id. Entity tags are
    compared first (weakly), else the dates of the last change.

    Returns record_id, url (canonical), ts, refers_to, refers_ts, digest, outcome and headers.
    Only where outcome is `resolved` the last four but outcome are set; headers are the stored
    ones with the permitted ones of the revisit. Null urls or ts resolve to nothing; repeated
    rows give their rows again; an empty table gives none.

    Captures are cut into ranges by URL and time, so that a URL with very many captures lies in
    many tasks; the last response of each range is carried into the later ones.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url").isNotNull() & F.col("ts").isNotNull()
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url"), "ts", F.coalesce(full, F.lit(False)).alias("full"),
        (F.col("kind") == "revisit").alias("revisit"), normal_headers(F.col("headers")).alias("headers"), "digest",
    ).where("full OR revisit")
    rows = rows.withColumn("stored", F.when(F.col("full"), F.struct("ts", "record_id", "headers", "digest")))
    order = ("ts", "full", "record_id")
    ranged = rows.repartitionByRange(shuffle_partitions(captures.sparkSession), "url", *order)
    ranged = cut(ranged.withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("range", "url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("found", F.last("stored", ignorenulls=True).over(earlier)).where("revisit").drop("stored", "full", "revisit")
    # What each range of a URL hands on; there are as many as ranges and URLs together.
    ends = ranged.groupBy("url", "range").agg(F.max_by("stored", F.struct("stored.ts", "stored.record_id")).alias("stored"))
    before = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("stored", ignorenulls=True).over(before)).where("carried IS NOT NULL")
    joined = within.join(carried.select("url", "range", "carried"), ["url", "range"], "left")
    found = F.when(F.col("url").isNotNull() & F.col("ts").isNotNull(), F.coalesce("found", "carried"))
    made = joined.withColumn("found", found).withColumn("outcome", _outcome(F.col("found.headers"), F.col("headers"), F.col("found")))
    resolved = lambda c: F.when(F.col("outcome") == "resolved", c)
    return made.select(
        "record_id", "url", "ts",
        resolved(F.col("found.record_id")).alias("refers_to"), resolved(F.col("found.ts")).alias("refers_ts"),
        resolved(F.col("found.digest")).alias("digest"), "outcome",
        resolved(merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


def with_payloads(resolved: DataFrame, captures: DataFrame, payload: str) -> DataFrame:
    """Resolved revisits with the payload of the response that they refer to; the others have none."""
    stored = captures.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col(payload)).dropDuplicates(["refers_to"])
    return resolved.join(stored, "refers_to", "left")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log over `pages`: each page is answered in full once and asked for again later.

    Page p is fetched at second 10 p (record 2 p) and again, with the validators of the first
    answer and a fragment at the url, at second 10 p + 100,005 (record 2 p + 1). Pages under
    https have entity tags; all have the date of their last change. Where another page of the
    same canonical URL was fetched in between, the validators do not agree.
    """
    secure = F.startswith(_lower(F.coalesce("url", F.lit(""))), F.lit("https"))
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.when(secure, F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')))
    changed = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    text = lambda c: c.cast("string")
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (10 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.octet_length(F.coalesce("html", F.lit("")))),
            F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), tag, F.lit("Last-Modified"), changed,
        ).alias("headers"),
        digest.alias("digest"),
    )
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (10 * F.col("page_id") + 100_005).alias("ts"),
        F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(
            F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("Date"), text(10 * F.col("page_id") + 100_005),
            F.lit("etag"), tag, F.lit("last-modified"), changed, F.lit("Set-Cookie"), F.lit("a=b"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)
