"""URL filters: a temporal join of captures with dated lists of hosts.

A list has entries (list, host, dated, action): from that date on the host, with all below it, is ``block``ed,
``allow``ed, or off the list (``clear``). Each entry holds until the next one of the same list and host: its
validity interval. A capture is judged by the entries that were active when it was fetched: the one for the most
labels of its host decides, and of several lists ``allow`` goes before ``block``.

Captures are first summed up to distinct (host, fetched): a host that holds a third of all pages is one row a
date. Each is expanded to its host's suffixes (127 at most, by the rules for host names), which meet the listed hosts,
a row for each with its intervals, in an equi-join that deals out suffixes that very many hosts share (com); of a host's
intervals those that hold at the time of fetching count. The verdicts are joined back in the same way, so that a host and
date with very many captures, and captures without a host, are dealt out too. Nothing is broadcast but hot keys, and what
Spark itself finds small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuscount.llm.skew import joined

#: The example lists, as (list, host, dated, action).
EXAMPLE_LISTS = (
    ("spam", "spam-farm.example.com", "2023-03-01", "block"),
    ("spam", "spam-farm.example.org", "2023-03-01", "block"),
    ("spam", "cheap-pills.example.com", "2023-06-15", "block"),
    ("spam", "cheap-pills.example.com", "2024-08-01", "clear"),
    ("gambling", "casino-win.example.com", "2024-02-01", "block"),
    ("gambling", "free-bets.example.com", "2023-11-20", "block"),
    ("gambling", "free-bets.example.com", "2024-05-05", "clear"),
    ("gambling", "free-bets.example.com", "2024-09-09", "block"),
    ("adult", "adult-x.example.net", "2022-01-01", "block"),
    ("ads", "ads-track.example.com", "2024-04-01", "block"),
    ("ads", "blog.ads-track.example.com", "2024-04-01", "allow"),
    ("ads", "m.casino-win.example.com", "2024-07-01", "allow"),
)


def host_of(url: Column) -> Column:
    """The URL's host in lower case, without user, port and final dot; null where there is none or none that is valid."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    host = F.lower(F.regexp_replace(raw, r"\.$", ""))
    return F.when(host.rlike(r"^[^.\s]+(?:\.[^.\s]+)*$") & (F.length(host) <= 253), host)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, host, action, since, until): until is exclusive and null while the entry still holds.

    Entries without a list, host or date are void; of several for one date the last of ``allow``, ``block``, ``clear`` counts.
    """
    e = entries.select("list", F.lower(F.trim("host")).alias("host"), F.col("dated").cast("date").alias("dated"), "action").where("list is not null and host is not null and dated is not null")
    e = e.groupBy("list", "host", "dated").agg(F.max("action").alias("action"))
    w = W.partitionBy("list", "host").orderBy("dated")
    return e.select("list", "host", "action", F.col("dated").alias("since"), F.lead("dated").over(w).alias("until")).where("action in ('allow', 'block')")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """captures with ``host``, ``verdict`` (allow, block or none), ``matched`` (the deciding host) and ``lists`` (joined by commas).

    A capture without a valid host (of at most 253 characters) or a fetch date has the verdict none. Every capture stays, repeated ones too;
    columns of captures named as the four new ones are replaced. Empty tables give empty results, an empty list none.
    """
    kept = [c for c in captures.columns if c not in ("host", "verdict", "matched", "lists")]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_own"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").cast("date").alias("_fetched"))
    asked = rows.where("host is not null and _fetched is not null").select("host", "_fetched").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k))")
    asked = asked.select("host", "_fetched", F.posexplode(suffixes).alias("_labels", "_key"))
    every = F.sort_array(F.collect_list(F.struct("list", "action", "since", "until")))
    valid = intervals(entries).groupBy(F.col("host").alias("_key")).agg(every.alias("_entries"))
    holds = lambda e: (F.col("_fetched") >= e["since"]) & (e["until"].isNull() | (F.col("_fetched") < e["until"]))
    active = joined(asked, valid, ["_key"], "inner").withColumn("_entries", F.filter("_entries", holds)).where(F.size("_entries") > 0)
    verdict = F.array_min(F.transform("_entries", lambda e: e["action"]))
    lists = F.array_join(F.array_distinct(F.transform("_entries", lambda e: e["list"])), ",")
    # of a capture's suffixes, 127 at most, the one of most labels decides
    decided = F.max_by(F.struct(verdict.alias("verdict"), F.col("_key").alias("matched"), lists.alias("lists")), "_labels")
    found = active.groupBy("host", "_fetched").agg(decided.alias("d"))
    out = joined(rows, found, ["host", "_fetched"], "left")
    return out.select(*[F.col(f"_own.`{c}`").alias(c) for c in kept], "host", F.coalesce("d.verdict", F.lit("none")).alias("verdict"), F.col("d.matched").alias("matched"), F.col("d.lists").alias("lists"))


def example_lists(spark: SparkSession) -> DataFrame:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in EXAMPLE_LISTS)
    return spark.sql(f"select list, host, cast(dated as date) as dated, action from values {rows} as v(list, host, dated, action)")


def lists_of(pages: DataFrame, url_col: str = "url", number: str = "page_id") -> DataFrame:
    """Dated entries made of pages' own hosts, as many as there are pages: a stand-in for lists of real size.

    By its number k a page gives an entry of list k % 4 for its host, for a host below it or for the domain above it, with a
    date of 2023 or 2024 and one of the three actions.
    """
    k, host = F.col(number), host_of(F.col(f"`{url_col}`"))
    name = F.when(k % 5 == 0, F.concat(F.lit("m."), host)).when(k % 7 == 0, F.regexp_replace(host, "^[^.]+[.](?=[^.]+[.])", "")).otherwise(host)
    action = F.when(k % 3 == 0, "allow").when(k % 11 == 0, "clear").otherwise("block")
    dated = F.date_add(F.lit("2023-06-01").cast("date"), (k * 37 % 500).cast("int"))
    return pages.where(host.isNotNull()).select(F.concat(F.lit("list"), (k % 4).cast("string")).alias("list"), name.alias("host"), dated.alias("dated"), action.alias("action"))
