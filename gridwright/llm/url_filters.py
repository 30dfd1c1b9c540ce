"""URL lists over time: which captures were on a list when they were fetched?

A list is a log of dated entries, each adding a pattern or removing it. A pattern's entries become validity
intervals; a capture's URL is turned into the few patterns that could name it, and an equi-join on the
pattern with a bound on the time finds the entry active at fetch time. Intervals of one list and pattern
never overlap, so a capture meets each pattern of a list at most once. The join is on many keys; a hot host
is one hot key on the captures' side only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import spare

#: Entries up to this number are sent to all tasks; it is counted before. Patterns longer than a URL may be never match.
BROADCAST_ENTRIES = 200_000

ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    """The lower-case host, empty where there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def path_of(url: Column) -> Column:
    """The path without query and fragment, in its own letters; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(host: Column, path: Column) -> Column:
    """All patterns that name a URL: ``host:h``, ``domain:`` of each suffix of the host, ``prefix:`` of each path start."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    starts = F.filter(
        F.transform(
            F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
            lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, 1, i), "/")),
        ),
        lambda p: p != F.concat(F.lit("prefix:"), host),
    )
    both = F.array_distinct(F.concat(F.array(F.concat(F.lit("host:"), host)), suffixes, starts))
    return F.when(F.length(host) > 0, both).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``(list, pattern, since, until)`` of entries ``(list, pattern, action, day)``.

    An added pattern is valid from its day up to the day of the pattern's next entry that removes it;
    ``until`` is null while none does. On one day a removal comes last. Entries that add what is valid, or
    remove what is not, change nothing. Entries with a null in any of the four columns are passed over.
    """
    known = entries.select("list", "pattern", "action", "day").dropna().where(F.col("action").isin(ADD, REMOVE))
    # Per pattern and day only the last action counts; then only its changes.
    daily = known.groupBy("list", "pattern", "day").agg((F.max("action") == ADD).alias("on"))
    history = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(history), F.lit(False))).where(F.col("on") != F.col("was"))
    return changes.withColumn("until", F.lead("day").over(history)).where("on").select(
        "list", "pattern", F.col("day").alias("since"), "until"
    )


def evaluate(captures: DataFrame, valid: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``blocked``, ``lists`` (sorted names, comma-joined) and ``pattern`` (the longest match).

    A capture without a URL, host or fetch day is not blocked; nor is any with an empty list. Equal
    captures are looked up once and each row gets the answer. Columns of the three names are replaced.
    """
    names = ("blocked", "lists", "pattern")
    kept = captures.drop(*[c for c in captures.columns if c.lower() in names])
    u, f = spare(kept, "u_"), spare(kept, "f_")
    asked = kept.select(F.col(url).alias(u), F.col(fetched).alias(f)).dropna().distinct()
    wanted = asked.withColumn("pattern", F.explode(patterns_of(host_of(F.col(u)), path_of(F.col(u)))))
    if valid.count() <= BROADCAST_ENTRIES:
        valid = F.broadcast(valid)
    hits = wanted.join(valid, "pattern").where(
        (F.col(f) >= F.col("since")) & (F.col("until").isNull() | (F.col(f) < F.col("until")))
    )
    found = hits.groupBy(u, f).agg(
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.max_by("pattern", F.struct(F.length("pattern"), "pattern")).alias("pattern"),
    )
    joined = kept.join(found, (F.col(url) == F.col(u)) & (F.col(fetched) == F.col(f)), "left").drop(u, f)
    return joined.withColumns(
        {"blocked": F.col("lists").isNotNull(), "lists": F.coalesce("lists", F.lit("")), "pattern": F.coalesce("pattern", F.lit(""))}
    )
