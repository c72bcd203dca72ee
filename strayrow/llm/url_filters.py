"""URL filters: allow and block rules by host and path, joined to urls by one sorted sweep.

A rule (host, path) fits a url if the url's host is the rule's or a subdomain of it and the url's
path starts with the rule's; the longest rule wins. The key of a rule is its host with the labels
reversed, ``?``, and its path; a url has such a key for every parent domain that has as few labels
as some rule. All keys that a rule fits then lie in one interval that starts at the rule's key,
and intervals are nested or apart.

The sweep sorts rules and urls together. At every place the rules that are open form a stack; the
last rule that started before a url carries the stack at its start, and what of it is still open
at the url is the part whose keys the url's key starts with. The sort is dealt out by ranges of
the key (equal keys can be split), and the stack open at the start of a range is handed on through
a table with one row for each range. Only DataFrame functions are used.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets the default;
rules without a host are ignored, a null path is empty; of equal rules with both verdicts ``block``
wins; of rules of equal length the one with the longer host wins, then the greater text; repeated
urls are judged one by one; an empty table gives an empty table, no rules give the default. Other
columns are kept; a column named like one of the four results is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayrow.functions.materialize import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule its key and the stack at its start: it and the rules around it, outermost first."""
    clean = (
        rules.select(
            F.translate("host", UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .where(F.length("host") > 0)
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(_reversed(F.col("host")), F.lit("?"), F.col("path")))
    )
    around = clean.select(
        "key",
        F.explode(F.sequence(F.length("key") - F.length("path"), F.length("key"))).alias("size"),
    ).select("key", F.substring("key", F.lit(1), F.col("size")).alias("outer"))
    return (
        around.join(clean.withColumnRenamed("key", "outer"), "outer")
        .groupBy("key")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.length("outer").alias("size"),
                        F.col("outer").alias("key"),
                        F.length("host").alias("host_size"),
                        F.concat("host", "path").alias("rule"),
                        "verdict",
                    )
                )
            ).alias("stack")
        )
    )


def judge_urls(
    urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The rows of ``urls`` with ``host``, ``path``, ``rule`` (like ``net/``, else null) and
    ``verdict``."""
    stacks = rule_stacks(rules)
    most = rules.agg(F.max(F.size(F.split("host", "\\.", -1)))).first()[0] or 0
    others = [c for c in urls.columns if c not in RESULTS]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    parsed = urls.select(
        F.struct(
            F.monotonically_increasing_id().alias("id"),
            *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)],
            host.alias("host"),
            path.alias("path"),
        ).alias("row")
    )
    labels = F.reverse(F.split("row.host", "\\.", -1))
    depths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(labels), F.lit(most))))
    points = parsed.withColumn("depth", F.explode(depths)).select(
        F.concat(
            F.array_join(F.slice(labels, F.lit(1), F.col("depth")), "."), F.lit("?"), F.col("row.path")
        ).alias("key"),
        F.col("row.id").alias("id"),
        F.when(F.col("depth") == 1, F.col("row")).alias("row"),  # carried once
    )
    events = stacks.withColumn("id", F.lit(-1).cast("long")).unionByName(points, allowMissingColumns=True)
    ranges = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = pin(
        events.repartitionByRange(ranges, "key", "id").withColumn("range", F.spark_partition_id())
    )

    last_in_range = swept.groupBy("range").agg(F.max(F.when(F.col("id") < 0, F.struct("key", "stack"))).alias("last"))
    # One row for each range.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = last_in_range.select(
        "range", F.last("last.stack", ignorenulls=True).over(earlier).alias("before")
    )
    sweep = Window.partitionBy("range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    open_stack = F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("before"))
    fitting = F.filter("stack", lambda r: F.col("key").startswith(r["key"]))
    best = F.element_at(fitting, -1)
    judged = (
        swept.join(F.broadcast(handed_on), "range")
        .withColumn("stack", open_stack)
        .where(F.col("id") >= 0)
        .select(
            "id",
            "row",
            F.when(
                F.size(fitting) > 0,
                F.struct(
                    F.length(best["rule"]).alias("size"),
                    best["host_size"].alias("host_size"),
                    best["rule"].alias("rule"),
                    best["verdict"].alias("verdict"),
                ),
            ).alias("best"),
        )
        .groupBy("id")
        .agg(F.first("row", ignorenulls=True).alias("row"), F.max("best").alias("best"))
    )
    return judged.select(
        *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(others)],
        F.col("row.host").alias("host"),
        F.col("row.path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
