"""Not-modified revisits of a web archive, resolved to the responses they refer to.

A revisit says that a page had not changed since an earlier capture. It is resolved to the latest
earlier full response with the same canonical URL: an as-of join. The response's validators
must agree with the revisit's, and headers that a not-modified answer may update replace the
response's own.

The as-of join works by slices of time of about SLICE_ROWS records each, however many a single
URL or second has: within a slice a window carries the last
response along, and from slice to slice a window over one row for each URL and slice does. No
task holds all records of a frequent URL. Bodies take no part and are joined by record id afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SLICE_ROWS = 1_000_000
#: Headers of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


def canonical(url: Column) -> Column:
    """A URL without what captures of one page differ in.

    Scheme, user, "www.", default ports, fragment, tracking parameters and a closing slash go;
    the host is in lower case, and parameters are in order. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i)https?://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers with the permitted ones of a not-modified answer; names are in lower case."""
    low = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda entries: F.map_from_entries(F.array_distinct(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.element_at(F.filter(entries, lambda x: x["key"] == e["key"]), -1)["value"].alias("value")))))
    fresh = F.filter(low(update), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(fresh, lambda e: e["key"])
    return F.when(stored.isNotNull(), last(F.concat(F.filter(low(stored), lambda e: ~F.array_contains(names, e["key"])), fresh)))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """rows with piece, the slice of time; written, as a sample lays the slices.

    They are cut between records, not between times, so records of one second can be many slices.
    """
    parts = -(-rows.count() // slice_rows)
    if parts < 2:
        return rows.withColumn("piece", F.lit(0))
    ranged = rows.repartitionByRange(parts, "at", F.col("kind") == "response", "record_id")
    return materialize(ranged.withColumn("piece", F.spark_partition_id()), "slices")


def resolve(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(record_id, url_key, response_id, outcome, status, headers): a row for each revisit of records.

    records has record_id long, kind ("response" or "revisit"), url, at (timestamp), status int
    and headers map<string,string>. A full response is one with kind response and status 200. Of
    responses at one time the largest record_id is the latest, and one at a revisit's own time is
    not earlier. outcome: "no response" if there is no earlier one; "mismatch" if an ETag that both
    have (weakly compared), or else a Last-Modified that both have, differs; "unverified" if they
    have neither in common; else "resolved". status and headers are null but for the last two,
    where they are the response's, with permitted headers updated. A null url or time finds no
    response. Repeated revisits are answered each. An empty table gives an empty result.
    """
    key = F.when(F.col("url").isNotNull() & F.col("at").isNotNull(), canonical(F.col("url")))
    of = lambda name: F.try_element_at(F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]
    rows = records.select("record_id", "kind", "at", "status", "headers", key.alias("url_key"), of("etag").alias("etag"), of("last-modified").alias("modified"))
    rows = rows.where("kind = 'revisit' or (kind = 'response' and status = 200 and url_key is not null)")
    rows = _sliced(rows, slice_rows)
    stored = F.struct("at", "record_id", "status", "headers", "etag", "modified")
    rows = rows.withColumn("own", F.when(F.col("kind") == "response", stored))
    # What a slice hands on: its last response; for each slice, that of the nearest earlier one.
    last = rows.where("kind = 'response'").groupBy("url_key", "piece").agg(F.max_by("own", F.struct("at", "record_id")).alias("last"))
    marks = rows.select("url_key", "piece").where("url_key is not null").distinct().join(last, ["url_key", "piece"], "left")
    before = Window.partitionBy("url_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(F.col("url_key").alias("k"), F.col("piece").alias("p"), F.last("last", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    # At equal times revisits come first, so they see earlier responses only.
    along = Window.partitionBy("url_key", "piece").orderBy("at", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.where("url_key is not null").withColumn("within", F.last("own", ignorenulls=True).over(along)).where("kind = 'revisit'")
    known = known.join(carried, (F.col("url_key") == F.col("k")) & (F.col("piece") == F.col("p")), "left").withColumn("found", F.coalesce("within", "carried"))
    lost = rows.where("url_key is null and kind = 'revisit'").withColumn("found", F.lit(None).cast(known.schema["found"].dataType))
    columns = ["record_id", "url_key", "etag", "modified", "headers", "found"]
    out = known.select(*columns).unionByName(lost.select(*columns))
    old = F.col("found")
    outcome = (
        F.when(old.isNull(), "no response")
        .when(F.col("etag").isNotNull() & old["etag"].isNotNull(), F.when(_weak(F.col("etag")) == _weak(old["etag"]), "resolved").otherwise("mismatch"))
        .when(F.col("modified").isNotNull() & old["modified"].isNotNull(), F.when(F.col("modified") == old["modified"], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unverified")
    return out.select(
        "record_id", "url_key", old["record_id"].alias("response_id"), "outcome", F.when(good, old["status"]).alias("status"),
        F.when(good, merged_headers(old["headers"], F.col("headers"))).alias("headers"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame, *bodies: str) -> DataFrame:
    """resolved with columns of the response's own record, such as its body; null where outcome is not a resolution.

    A response's record_id should be unique: of several, each gives a row. Bodies may be null, empty
    or very long; an empty table gives an empty result.
    """
    own = records.where("kind = 'response'").select(F.col("record_id").alias("body_of"), *bodies)
    good = F.col("outcome").isin("resolved", "unverified")
    return resolved.join(own, good & (F.col("response_id") == F.col("body_of")), "left").drop("body_of")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made of pages: for each, a full response, and a later revisit by another form of its URL.

    Pages are captured a minute apart. Of seven responses one has status 503. Every fifth revisit
    has an ETag of its own, every third of the others has none, and every ninth precedes the response.
    A null html is an empty body, a null url stays null, and a repeated page gives its records again;
    other columns are not read.
    """
    i, body = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(body.cast("binary")), 1, 16), F.lit('"'))
    stamp = lambda seconds: F.timestamp_seconds(F.lit(1_600_000_000) + seconds)
    response = pages.select(
        (2 * i).alias("record_id"), F.lit("response").alias("kind"), "url", stamp(60 * i).alias("at"), F.when(i % 7 == 6, 503).otherwise(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length(body).cast("string"), F.lit("Cache-Control"), F.lit("no-cache")).alias("headers"), body.alias("body"),
    )
    other = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://", "HTTP://WWW.")
    wrong = F.concat(F.lit('"stale-'), i.cast("string"), F.lit('"'))
    own = F.when(i % 5 == 4, wrong).when(i % 3 == 2, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    age = F.concat(F.lit("max-age="), (i % 100).cast("string"))
    revisit = pages.select(
        (2 * i + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(other, F.when(i % 2 == 0, "#again").otherwise("")).alias("url"),
        stamp(60 * i + F.when(i % 9 == 8, -30).otherwise(3600 * (1 + i % 7))).alias("at"), F.lit(304).alias("status"),
        F.map_filter(F.create_map(F.lit("etag"), own, F.lit("cache-control"), age, F.lit("content-length"), F.lit("0")), lambda k, v: v.isNotNull()).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures(table(spark, sf_dir, "pages")).withColumn("digest", F.md5(F.col("body").cast("binary")))
    found = with_bodies(resolve(records), records, "digest")
    return found.select(
        F.expr("(record_id - 1) div 2").alias("page_id"), "url_key", "response_id", "outcome", "status",
        F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n").alias("headers"), F.col("digest").alias("body_md5"),
    )


_SQL = r"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
r as (select 2 * page_id as record_id, 'response' as kind, url, 1600000000 + 60 * page_id as t, case when page_id % 7 = 6 then 503 else 200 end as status,
    '"' || substr(md5(html), 1, 16) || '"' as etag, strlen(html) as size, cast(null as varchar) as age, md5(html) as digest from p
  union all
  select 2 * page_id + 1, 'revisit', regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', 'HTTP://WWW.') || case when page_id % 2 = 0 then '#again' else '' end,
    1600000000 + 60 * page_id + case when page_id % 9 = 8 then -30 else 3600 * (1 + page_id % 7) end, 304,
    case when page_id % 5 = 4 then '"stale-' || page_id || '"' when page_id % 3 = 2 then null else 'W/"' || substr(md5(html), 1, 16) || '"' end, 0, 'max-age=' || (page_id % 100), null from p),
b as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') as bare from r),
c as (select *, lower(regexp_replace(regexp_extract(bare, '^[^/?]*'), '^[^@]*@', '')) as host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{tracking}'))) as q from b),
k as (select *, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^www\d*\.', '') || path || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as url_key from c),
m as (select v.*, f.record_id as response_id, f.status as old_status, f.etag as old_etag, f.size as old_size, f.digest as old_digest,
    row_number() over (partition by v.record_id order by f.t desc nulls last, f.record_id desc) as n
  from k v left join k f on f.kind = 'response' and f.status = 200 and f.url_key = v.url_key and f.t < v.t where v.kind = 'revisit'),
o as (select *, case when response_id is null then 'no response' when etag is not null then case when regexp_replace(etag, '^W/', '') = old_etag then 'resolved' else 'mismatch' end
  else 'unverified' end as outcome from m where n = 1)
select (record_id - 1) // 2 as page_id, url_key, response_id, outcome, case when outcome in ('resolved', 'unverified') then old_status end as status,
  case when outcome in ('resolved', 'unverified') then 'cache-control: ' || age || chr(10) || 'content-length: ' || old_size || chr(10) || 'etag: ' || coalesce(etag, old_etag) end as headers,
  case when outcome in ('resolved', 'unverified') then old_digest end as body_md5
from o"""

QUERIES = {"op4_warc_revisits": op4_warc_revisits}
ORACLE = {"op4_warc_revisits": _SQL.replace("{tracking}", TRACKING)}
