"""Dated URL lists joined to captures as of the time of fetching, in DataFrame functions only.

A list is a table of dated events: an entry is put on it, or taken off. Each entry's events become intervals of
validity that don't overlap, and a capture is held against the entries that were valid when it was fetched: its host, each
parent domain, and each path prefix are looked up by equality, with the day inside the interval. An entry matches a
capture once at most, so the join never makes more rows than a capture has keys, and only matches go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists of up to this number of intervals are broadcast. Longer ones are joined by shuffle, a key's captures dealt out to
#: ``SALT`` tasks, each of which has the key's intervals: ``com`` is a key of a large part of all captures.
BROADCAST_INTERVALS = 200_000
SALT = 32


def host(url: str = "url") -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def keys(url: str = "url") -> Column:
    """What a list can name of a URL: its host, the host's parent domains, and the host with each path prefix."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def intervals(events: DataFrame) -> DataFrame:
    """``key, day, listed`` to ``key, since, until``: when each key was on the list, ``until`` excluded and null if it still is.

    Of a key the host is in lower case, as hosts are the same in either; paths are not. Events without key or day are left out; listing what is listed already changes nothing; of several events of a
    key on one day a removal holds.
    """
    name = F.substring_index("key", "/", 1)
    key = F.concat(F.lower(name), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))
    day = events.where("key is not null and day is not null and listed is not null").groupBy(key.alias("key"), F.col("day").cast("date").alias("day")).agg(F.min("listed").alias("listed"))
    by_key = Window.partitionBy("key").orderBy("day")
    changes = day.withColumn("before", F.coalesce(F.lag("listed").over(by_key), F.lit(False))).where(F.col("listed") != F.col("before"))
    return changes.withColumn("until", F.lead("day").over(by_key)).where("listed").select("key", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``id, url, fetched, host, n_active, blocked, entry, listed_on`` of every capture.

    ``entry`` is the longest of the keys that were listed on the day of the fetch, then the smallest by code points, and
    ``listed_on`` the day since when. A null or malformed URL has no host and matches nothing, nor does a capture without
    a day. URLs are read whole, however long; each path prefix is a key. Repeated rows stay repeated, null ids stay null, empty tables give no rows or no matches; other columns of
    either table are not read.
    """
    valid = intervals(events)
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("fetched"))
    asked = rows.distinct().withColumn("key", F.explode(keys("url")))
    near = valid.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    salt = F.lit(0) if near else F.pmod(F.xxhash64("url", "id"), F.lit(SALT)).cast("int")
    asked = asked.withColumn("salt", salt)
    valid = F.broadcast(valid.withColumn("salt", F.lit(0))) if near else valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    active = asked.join(valid, (asked["key"] == valid["key"]) & (asked["salt"] == valid["salt"]) & (asked["fetched"] >= valid["since"]) & (valid["until"].isNull() | (asked["fetched"] < valid["until"]))).drop(valid["key"], valid["salt"])
    best = F.min(F.struct((-F.length("key")).alias("size"), "key", "since"))
    matched = active.groupBy("id", "url", "fetched").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).select(F.col("id").alias("m_id"), F.col("url").alias("m_url"), F.col("fetched").alias("m_fetched"), "n", "best")
    out = rows.join(matched, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("url") == F.col("m_url")) & (F.col("fetched") == F.col("m_fetched")), "left")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(day_col), host("url").alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.col("n").isNotNull().alias("blocked"), F.col("best.key").alias("entry"), F.col("best.since").alias("listed_on"))
