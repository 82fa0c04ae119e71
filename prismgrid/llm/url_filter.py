"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated events: an entry (``host``, ``domain`` or ``path`` rule) is added or
removed. Per entry the log becomes validity intervals [valid_from, valid_to), and each
capture is judged by the entries that were active when it was fetched: an as-of join.

Rules, most specific first: ``path`` matches host and first path segment, ``host`` the exact
host, ``domain`` the host and all its subdomains.

Captures are evaluated once per distinct (host, first path segment, fetch time), so a hot host
costs its distinct fetch times, and the verdicts are joined back with a sort-merge join whose
skewed partitions adaptive execution may split. Nothing is broadcast by hint.

Nulls: a capture without URL, host or time is kept and not blocked; list events without key,
rule or time are ignored; unknown actions count as removal. Of several events of an entry at one
time removal wins. Repeated captures and events change nothing but the number of rows. Other
columns pass through; columns named like a result (``host``, ``path1``, ``n_active``,
``blocked``, ``rule``, ``listed_key``, ``active_since``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Specificity of the rules.
RULES = ("path", "host", "domain")
RESULT = ("host", "path1", "n_active", "blocked", "rule", "listed_key", "active_since")


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (lower case, without user, port and trailing dot) and ``path1``."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path1", F.coalesce(path, F.lit("")))


def intervals(events: DataFrame) -> DataFrame:
    """``(rule, key, valid_from, valid_to)`` from ``events(rule, key, action, at)``.

    Consecutive additions are merged, an open interval ends in null.
    """
    entry = Window.partitionBy("rule", "key").orderBy("at")
    known = events.filter(F.col("rule").isin(*RULES) & F.col("key").isNotNull() & F.col("at").isNotNull())
    state = known.groupBy("rule", "key", "at").agg(
        F.min(F.coalesce((F.col("action") == "add").cast("int"), F.lit(0))).alias("on")
    )
    changes = state.withColumn("was", F.coalesce(F.lag("on").over(entry), F.lit(0))).filter("on <> was")
    spans = changes.withColumn("valid_to", F.lead("at").over(entry))
    return spans.filter("on = 1").select("rule", "key", F.col("at").alias("valid_from"), "valid_to")


def candidates(keys: DataFrame) -> DataFrame:
    """One row per rule key that can match ``(host, path1)``: the path, the host, each parent domain."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.lit(3).alias("order"),
            F.lit("domain").alias("rule"),
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"),
        ),
    )
    one = lambda order, rule, key: F.struct(F.lit(order).alias("order"), F.lit(rule).alias("rule"), key.alias("key"))
    exact = F.array(one(1, "path", F.concat_ws("/", "host", "path1")), one(2, "host", F.col("host")))
    return keys.withColumn("c", F.explode(F.concat(exact, suffixes))).select("*", "c.*").drop("c")


def filter_urls(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetch_time") -> DataFrame:
    """``captures`` with the verdict of the list as it stood at each fetch.

    Adds ``host``, ``path1``, ``n_active`` (long: active entries that match), ``blocked`` and the
    most specific match: ``rule``, ``listed_key``, ``active_since`` (ties: the longest key).
    """
    passed = [c for c in captures.columns if c not in RESULT or c in (url, at)]
    # Columns of the captures travel in one struct, so that none can clash with those of the join.
    rows = url_parts(captures.select(F.struct(*[F.col(f"`{c}`") for c in passed]).alias("_row"), F.col(url).alias("_url"), F.col(at).alias("_at")), "_url")
    keys = rows.select("host", "path1", "_at").filter("host <> '' and _at is not null").distinct()
    hit = _active(candidates(keys), intervals(events))
    best = F.min(F.struct("order", (-F.length("key")).alias("n"), "rule", "key", "valid_from"))
    verdict = hit.groupBy("host", "path1", "_at").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best"))
    judged = rows.join(verdict, ["host", "path1", "_at"], "left")
    return judged.select(
        *[F.col("_row")[c].alias(c) for c in passed],
        *[c for c in ("host", "path1") if c not in passed],
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("best").isNotNull().alias("blocked"),
        F.col("best.rule").alias("rule"),
        F.col("best.key").alias("listed_key"),
        F.col("best.valid_from").alias("active_since"),
    )


def _active(keys: DataFrame, active: DataFrame) -> DataFrame:
    """The as-of join: equal rule and key, fetched within the interval."""
    spans = active.withColumnRenamed("rule", "_rule").withColumnRenamed("key", "_key")
    return keys.join(
        spans,
        (F.col("rule") == F.col("_rule"))
        & (F.col("key") == F.col("_key"))
        & (F.col("_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))),
    ).drop("_rule", "_key")
