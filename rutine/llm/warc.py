"""WARC: not-modified revisits resolved by an as-of join.

A revisit record says that a server answered "not modified"; it has no payload. It is joined, by canonical URL, to the latest full
response before it. If the validators of both agree, the revisit gets that response's payload and headers, with the
headers that such an answer may update taken from the revisit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.llm.common import table, written

#: Headers of a not-modified answer that replace stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = "^(utm_[a-z]+|gclid|fbclid)(=|$)"
#: Time buckets into which a URL's records are dealt.
BUCKETS = 65_536


def canonical_url(url: Column) -> Column:
    """Host in lower case without user or default port, path, and sorted query; no scheme, fragment or tracking parameter.

    Null stays null; something that is no URL is kept as it is, but for its fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "^$", "/")
    query = F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _plain(tag: Column) -> Column:
    """An entity tag without the mark of a weak one."""
    return F.regexp_replace(tag, "^W/", "")


def by_lower_name(headers: Column) -> Column:
    """Headers by their names in lower case, one entry a name: of several spellings the last by code points counts. Null is empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda name: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), -1)["value"]
    return F.map_from_entries(F.transform(names, lambda name: F.struct(name.alias("key"), value(name).alias("value"))))


def _sources(asked: DataFrame, buckets: int) -> DataFrame:
    """(url_key, at, source_id, source_at) of the times (url_key, at) of revisits: the latest earlier time at which the URL has a response.

    asked has (url_key, at, kind, record_id). Times are folded first, however many records share one. They are dealt into buckets of equal
    width between the 0.1 % and the 99.9 % quantile of all times, whatever their unit; what a bucket needs from before is the last
    response of an earlier one, found by aggregation, so that a URL with a third of all records is many small groups."""
    own = F.max(F.when(F.col("kind") == "response", F.col("record_id")))
    times = written(asked.groupBy("url_key", "at").agg(own.alias("own"), F.max(F.col("kind") == "revisit").alias("asks")), "times")
    low, high = times.agg(F.percentile_approx("at", [0.001, 0.999]).alias("q")).first().q or (0, 0)
    place = (F.col("at").cast("double") - float(low)) * (buckets / max(float(high) - float(low), 1.0))
    times = times.withColumn("bucket", F.greatest(F.lit(-1.0), F.least(F.lit(float(buckets)), F.floor(place).cast("double"))).cast("int"))
    full = F.when(F.col("own").isNotNull(), F.col("at"))
    last = times.groupBy("url_key", "bucket").agg(F.max(full).alias("last_at"), F.max_by("own", full).alias("last_id"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url_key", "bucket", F.last("last_at", ignorenulls=True).over(before).alias("far_at"), F.last("last_id", ignorenulls=True).over(before).alias("far_id"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = times.withColumns({"near_at": F.last(full, ignorenulls=True).over(inside), "near_id": F.last("own", ignorenulls=True).over(inside)}).where("asks")
    found = near.join(carried, ["url_key", "bucket"])
    return found.select("url_key", "at", F.coalesce("near_id", "far_id").alias("source_id"), F.coalesce("near_at", "far_at").alias("source_at"))


def resolve_revisits(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Records with revisits resolved: (record_id, url_key, kind, resolved_id, state, headers, body), one row for each of records.

    records has record_id and at (long), url, kind ('response' or 'revisit'), etag, last_modified (string), headers (map) and body
    (string); other columns are ignored. A response is itself: resolved_id is its own id, state 'full'. A revisit is 'resolved' if the latest response of its canonical
    URL with a smaller `at` (of several at that time, that with the largest id) has an equal entity tag, compared weakly, or, where
    the revisit has none, an equal last-modified; 'changed' if it has not; 'missing' if there is no such response or url or at is null.
    A revisit that names no validator is 'changed'. Unresolved revisits keep their own headers and have no body. Any other
    kind, null too, is passed through as state 'other'. Header names are compared, and given, in lower case. Null headers are empty, and an
    empty table gives an empty one. Responses without a record_id answer nothing. Rows that repeat a revisit are resolved each; of responses that repeat record_id, url and at, one answers.

    Only ids, URLs and times are shuffled to find the answering response; its headers and body, of whatever length, are joined last, by id."""
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "at", "kind", "etag", "last_modified", by_lower_name(F.col("headers")).alias("headers"), "body")
    asked = rows.where("url_key IS NOT NULL AND at IS NOT NULL AND (kind = 'revisit' OR kind = 'response' AND record_id IS NOT NULL)")
    sources = written(_sources(asked.select("url_key", "at", "kind", "record_id"), buckets), "sources")
    revisits = rows.where("kind = 'revisit'").drop("body").join(sources, ["url_key", "at"], "left")
    wanted = sources.select(F.col("source_id").alias("record_id"), "url_key", F.col("source_at").alias("at")).where("record_id IS NOT NULL").distinct()
    answers = rows.where("kind = 'response'").join(wanted, ["record_id", "url_key", "at"], "left_semi").dropDuplicates(["record_id", "url_key", "at"])
    answers = answers.select(F.col("record_id").alias("source_id"), "url_key", F.col("at").alias("source_at"), F.struct("etag", "last_modified", "headers", "body").alias("from"))
    found = revisits.join(written(answers, "answers"), ["source_id", "url_key", "source_at"], "left")
    same = F.when(F.col("etag").isNotNull(), _plain(F.col("etag")) == _plain(F.col("from.etag"))).otherwise(F.col("last_modified") == F.col("from.last_modified"))
    state = F.when(F.col("from").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("changed")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_zip_with(F.col("from.headers"), fresh, lambda k, old, new: F.coalesce(new, old))
    ok = F.col("state") == "resolved"
    found = found.withColumn("state", state).select(
        "record_id", "url_key", "kind", F.when(ok, F.col("source_id")).alias("resolved_id"), "state", F.when(ok, merged).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("from.body")).alias("body")
    )
    is_full = F.coalesce(F.col("kind") == "response", F.lit(False))
    rest = rows.where("kind IS NULL OR kind <> 'revisit'")
    rest = rest.select("record_id", "url_key", "kind", F.when(is_full, F.col("record_id")).alias("resolved_id"), F.when(is_full, "full").otherwise("other").alias("state"), "headers", "body")
    return rest.unionByName(found)


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl and a recrawl of pages (page_id, url, html).

    Each page is a response at the time of its page_id, and is asked for again 100 units later under a URL with a fragment. The
    recrawl's entity tag is the page's own, weak; every fifth page has a last-modified instead, and the one after that a stale tag.
    The crawl spells header names in capitals, the recrawl in lower case."""
    digest, five = F.md5(F.coalesce("html", F.lit(""))), F.pmod("page_id", F.lit(5))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.col("page_id").alias("at"), "url", F.lit("response").alias("kind"), F.concat(F.lit('"'), digest, F.lit('"')).alias("etag"),
        F.col("page_id").cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.col("page_id").cast("string"), F.lit("Cache-Control"), F.lit("max-age=1"), F.lit("Server"), F.lit("one")).alias("headers"), F.coalesce("html", F.lit("")).alias("body"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") + 100).alias("at"), F.concat("url", F.lit("#again")).alias("url"), F.lit("revisit").alias("kind"),
        F.when(five == 1, '"stale"').when(five > 1, F.concat(F.lit('W/"'), digest, F.lit('"'))).alias("etag"),
        F.when(five == 0, F.col("page_id").cast("string")).alias("last_modified"),
        F.create_map(F.lit("date"), (F.col("page_id") + 100).cast("string"), F.lit("cache-control"), F.lit("max-age=9"), F.lit("set-cookie"), F.lit("a=b")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(again)


def op7_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages", "page_id", "url", "html").where("page_id IS NOT NULL")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("record_id", "url_key", "resolved_id", "state", headers.alias("headers"), F.sha2("body", 256).alias("body_sha256"))


ORACLE = {
    "op7_revisits": r"""
        WITH p AS (SELECT page_id, md5(coalesce(html, '')) AS d, coalesce(html, '') AS body, page_id % 5 AS five,
                          regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest FROM pages WHERE page_id IS NOT NULL),
        k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
                     lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)(=|$)'))), '&') AS kept FROM p),
        u AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', '')
                     || CASE WHEN regexp_extract(rest, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?]*([^?]*)', 1) END
                     || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url_key FROM k),
        r AS (SELECT v.page_id, v.url_key, v.five, v.d, f.page_id AS old, f.d AS old_d, f.body AS old_body,
                     row_number() OVER (PARTITION BY v.page_id ORDER BY f.page_id DESC) AS n
              FROM u v LEFT JOIN u f ON v.url_key = f.url_key AND f.page_id < v.page_id + 100),
        s AS (SELECT *, CASE WHEN old IS NULL THEN 'missing' WHEN five = 0 AND old = page_id THEN 'resolved' WHEN five > 1 AND d = old_d THEN 'resolved'
                        ELSE 'changed' END AS state FROM r WHERE n = 1)
        SELECT 2 * page_id AS record_id, url_key, 2 * page_id AS resolved_id, 'full' AS state,
               'cache-control=max-age=1;content-type=text/html;date=' || page_id || ';server=one' AS headers, sha256(body) AS body_sha256 FROM u
        UNION ALL
        SELECT 2 * page_id + 1, url_key, CASE WHEN state = 'resolved' THEN 2 * old END, state,
               CASE WHEN state = 'resolved' THEN 'cache-control=max-age=9;content-type=text/html;date=' || (page_id + 100) || ';server=one'
                    ELSE 'cache-control=max-age=9;date=' || (page_id + 100) || ';set-cookie=a=b' END, CASE WHEN state = 'resolved' THEN sha256(old_body) END FROM s""",
}
