"""URL filters by a temporal list join, in DataFrame operations only.

Dated list entries (add or remove a key at a time) become validity intervals with a window over each
key's history: repeated adds do not restart an interval, a remove closes it, of several entries at
one time the remove counts. Every capture offers its host, the domains above it, and its path
prefixes as keys; an as-of join finds the entries active at its fetch time (since <= fetched < until),
and the most specific active entry decides, the newer one among equals, then block before allow.

Intervals are grouped by key before the join, so the join has a row for each capture and key
whatever the number of edits, and the interval active at the fetch time is picked from the key's
list. Lists are broadcast only while their keys are below ``broadcast_rows``; beyond it captures
are first reduced to distinct (key, fetch time) pairs, which collapses a hot host, and joined by shuffle.

Edge cases: a null, empty or malformed url offers no key and is kept; a host that is an IPv4 or
bracketed IPv6 address offers itself alone; a null fetch time matches nothing; entries with null key,
time or action are ignored; repeated rows are answered row by row; an empty list blocks nothing, an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, col_of, materialise, with_rid

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
#: Hosts that are addresses: nothing stands above them.
ADDRESS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def keys_of(url: Column, depth: int = 4) -> Column:
    """(key, rank): the domains above the host and the host itself by labels, then path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    top = F.when(host.rlike(ADDRESS), F.size(labels)).otherwise(F.lit(1))
    up = F.transform(F.sequence(top, F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, -i, i), ".").alias("key"), i.alias("rank")))
    parts = F.slice(F.array_remove(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), ""), 1, depth)
    down = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"), (i + 100).alias("rank"))))
    none = F.array().cast("array<struct<key: string, rank: int>>")
    return F.when(host != "", F.concat(up, F.coalesce(down, none))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, key, since, until) from entries (list, verdict, key, action, at); until is null while active."""
    at = entries.where("key is not null and at is not null and action in ('add', 'remove')")
    at = at.groupBy("list", "verdict", "key", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "verdict", "key").orderBy("at")
    turns = at.withColumn("before", F.lag("action").over(w)).where("(before is null and action = 'add') or before <> action")
    return turns.withColumn("until", F.lead("at").over(w)).where("action = 'add'").select("list", "verdict", "key", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, broadcast_rows: int = 500_000) -> DataFrame:
    """(__rid, id_col, host, n_active, decided_by, list, since, blocked) for every capture."""
    by_key = intervals(entries).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("since", "until", "list", "verdict"))).alias("spans"))
    by_key = materialise(by_key, "intervals")
    src = with_rid(captures.select(col_of(captures, id_col).alias("i"), col_of(captures, url_col).alias("url"), col_of(captures, time_col).alias("fetched")))
    offered = src.select(RID, "fetched", F.explode(keys_of(F.col("url"))).alias("k")).select(RID, "fetched", "k.key", "k.rank")
    active = F.filter("spans", lambda s: (s["since"] <= F.col("fetched")) & (s["until"].isNull() | (s["until"] > F.col("fetched"))))
    verdicts = F.transform(active, lambda s: F.struct(F.col("rank"), s["since"].alias("since"), (s["verdict"] == "block").alias("block"), F.col("key"), s["list"].alias("list")))
    if by_key.count() <= broadcast_rows:
        met = offered.join(F.broadcast(by_key), "key")
    else:
        asked = offered.groupBy("key", "rank", "fetched").agg(F.count("*").alias("n"))
        hits = asked.join(by_key, "key").where(F.size(active) > 0).select("key", "rank", "fetched", "spans")
        met = offered.join(hits, ["key", "rank", "fetched"])
    per = met.select(RID, verdicts.alias("v")).where(F.size("v") > 0).groupBy(RID).agg(F.sum(F.size("v")).alias("n"), F.max(F.array_max("v")).alias("best"))
    return src.select(RID, "i", host_of(F.col("url")).alias("host")).join(per, RID, "left").select(
        RID,
        F.col("i").alias(id_col),
        "host",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.key").alias("decided_by"),
        F.col("best.list").alias("list"),
        F.col("best.since").alias("since"),
        F.coalesce("best.block", F.lit(False)).alias("blocked"),
    )
