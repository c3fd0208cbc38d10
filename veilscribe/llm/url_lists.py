"""URL filter lists that change over time.

Entries say that a host, with all hosts below it, enters or leaves a list on a date.
They become validity intervals; a capture is judged by the interval of each list that
holds at its fetch time, which is an as-of join of captures with entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscribe.llm.store import Workspace, free


#: Parts that a pattern's captures are dealt into.
SALTS = 16
_ADDRESS = r"^\[|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def host_of(url) -> F.Column:
    """The host of a URL in lower case without port, user and final dot, an IPv6 address in its brackets; null if there is none."""
    host = F.regexp_extract(F.lower(F.col(url) if isinstance(url, str) else url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame, *, list_col: str = "list", pattern_col: str = "pattern", action_col: str = "action", since_col: str = "since") -> DataFrame:
    """list, pattern, valid_from, valid_to (null: open): when each pattern is on each list.

    An entry holds from its date until the next one of the same list and pattern.  Of
    entries of the same date, ``add`` wins.  Entries with a null list, pattern, action or
    date, or an action other than add and remove, are no entries.
    """
    named = entries.select(F.col(list_col).alias("list"), F.lower(F.col(pattern_col)).alias("pattern"), F.lower(F.col(action_col)).alias("action"), F.col(since_col).alias("valid_from"))
    days = named.na.drop().filter(F.col("action").isin("add", "remove")).groupBy("list", "pattern", "valid_from").agg(F.min("action").alias("action"))
    order = Window.partitionBy("list", "pattern").orderBy("valid_from")
    return days.withColumn("valid_to", F.lead("valid_from").over(order)).filter("action = 'add'").select("list", "pattern", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", at_col: str = "fetched_on", **entry_cols: str) -> DataFrame:
    """``captures`` with added columns host, lists (sorted names of the lists that hold the host when it was fetched) and blocked.

    A pattern covers the host itself and every host below it.  A null or hostless URL,
    or a null fetch time, is on no list; no capture is lost and repeated rows stay.
    Without entries nothing is blocked.  Columns of ``captures`` stay; if one is named
    like a result, the result has an underscore after it.

    A host that is an IPv4 or IPv6 address has no host above it.

    Captures are first reduced to distinct hosts and times, and each to the patterns that
    cover it and are on some list.  These and the entries are then sorted by time, so that
    each finds the last entry before it: an as-of join.  A pattern's captures are dealt out
    by a salt, with its entries to each, so that a hot host is no task of its own.
    """
    host_, lists_, blocked_, of_, at_, found_ = free(captures.columns, "host", "lists", "blocked", "of", "at", "found")
    space = Workspace(captures.sparkSession, "url-lists")
    held = space.table(intervals(entries, **entry_cols), "intervals")
    hosted = captures.withColumn(host_, host_of(url_col))
    asked = hosted.select(F.col(host_).alias("host"), F.col(at_col).alias("time")).na.drop().distinct()
    labels = F.when(F.col("host").rlike(_ADDRESS), F.array("host")).otherwise(F.split("host", r"\."))
    # a.b.c: a.b.c, b.c, c
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.concat_ws(".", F.slice("labels", k, F.size("labels"))))
    tried = asked.withColumn("labels", labels).select("host", "time", F.explode(tails).alias("tail"))
    named = held.select(F.col("pattern").alias("tail"), "list").distinct()
    asks = tried.join(named, "tail").select("tail", "list", F.pmod(F.xxhash64("host", "time"), F.lit(SALTS)).cast("int").alias("salt"), "time", "host", F.lit(None).alias("until"))
    marks = held.select(F.col("pattern").alias("tail"), "list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("valid_from").alias("time"), F.lit(None).cast("string").alias("host"), F.struct("valid_to").alias("until"))
    order = Window.partitionBy("tail", "list", "salt").orderBy("time", F.col("host").isNotNull())
    judged = marks.unionByName(asks).withColumn("until", F.last("until", ignorenulls=True).over(order)).filter("host IS NOT NULL AND until IS NOT NULL AND (until.valid_to IS NULL OR time < until.valid_to)")
    found = judged.groupBy(F.col("host").alias(of_), F.col("time").alias(at_)).agg(F.sort_array(F.collect_set("list")).alias(found_))
    out = hosted.join(found, (hosted[host_] == found[of_]) & (hosted[at_col] == found[at_]), "left")
    lists = F.coalesce(found_, F.array().cast("array<string>"))
    return out.select(*captures.columns, host_, lists.alias(lists_), (F.size(lists) > 0).alias(blocked_))
