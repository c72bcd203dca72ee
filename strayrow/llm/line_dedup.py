"""Line dedup by site: drop lines that stand on too large a share of a host's pages.

For every host, the pages that contain a line are counted and divided by the host's pages. A line
is boilerplate of the host if that share exceeds ``ratio`` and at least ``least`` pages hold it;
every page of the host loses it. Rows of a host with equal texts are one page, so that a page does
not lose its lines to its own copies. With ``copies``, near copies are one page too: the rows of a
host in one group of ``jaccard.similar_groups``, which links texts by the similarity of their word
shingles. Lines are compared without blanks, tabs and carriage returns at their ends, by a 64-bit
hash; lines that are empty then are never dropped.

A host has at most (lines per page) / ratio boilerplate lines, so each host's hashes travel as one
array. Hosts are attached to the rows by ``functions.skew.attach``: all by broadcast if their
hashes are counted and few, else hot hosts by broadcast and the rest by a salted join.

Edge cases: rows without a host form one host; a null text stays null and is no page; a text that
loses all its lines becomes empty, its row stays; an empty table gives an empty table; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.materialize import Scratch, pin
from strayrow.functions.skew import attach
from strayrow.llm.jaccard import similar_groups

RATIO = 0.01
LEAST = 3
BROADCAST_HASHES = 500_000


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _near_copies(texts: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """``page`` and ``group`` of the pages whose group has another page."""
    keyed = texts.select(F.xxhash64("text").alias("page"), "text")
    groups = similar_groups(keyed, shingle, similarity, "page", "text")
    # A group's name is its smallest page, which needs no row here.
    return pin(
        groups.where(F.col("page") != F.col("component_id"))
        .groupBy("page")
        .agg(F.min("component_id").alias("group"))
    )


def boilerplate(
    docs: DataFrame,
    host_col: str,
    text_col: str,
    ratio: float = RATIO,
    least: int = LEAST,
    copies: tuple[int, tuple[int, int]] | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Host, line hash, pages with the line and pages of the host, where the share is too large.

    What it reads is the table ``pages`` of ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    slim = docs.select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text"))
    hashes = F.transform(
        F.filter(_lines("text"), lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x))
    )
    pages = scratch.keep(
        slim.where(F.col("text").isNotNull())
        .select("host", F.xxhash64("text").alias("page"), F.array_distinct(hashes).alias("lines"))
        .dropDuplicates(["host", "page"]),
        "pages",
    )
    count = F.count(F.lit(1))
    if copies is not None:
        near = _near_copies(slim.select("text"), *copies)
        pages = pages.join(near, "page", "left").select(
            "host", F.coalesce("group", "page").alias("page"), "lines"
        )
        count = F.count_distinct("page")
    by_line = (
        pages.select("host", "page", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(count.alias("pages"))
        .where(F.col("pages") >= least)
    )
    totals = pages.groupBy("host").agg(count.alias("host_pages"))
    # Hosts with no line that often drop out in the join; a hot host is one row here.
    return by_line.join(totals, by_line["host"].eqNullSafe(totals["host"])).select(
        by_line["host"], "line", "pages", "host_pages"
    ).where(F.col("pages") > F.col("host_pages") * F.lit(ratio))


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    least: int = LEAST,
    counts: bool = False,
    copies: tuple[int, tuple[int, int]] | None = None,
) -> DataFrame:
    """The rows with boilerplate lines cut out of the text; ``counts`` adds ``n_lines`` and
    ``n_dropped``; ``copies`` (shingle, similarity) counts near copies as one page."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    hosts = pin(
        boilerplate(docs, host_col, text_col, ratio, least, copies, scratch)
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"), F.first("host_pages").alias("pages"))
        .select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("_host"),
                F.col("host").isNull().alias("_no_host"),
                F.col("lines").alias("_lines"), F.col("pages").alias("_pages"))
    )
    scratch.drop("pages")
    total = hosts.agg(F.sum(F.size("_lines")).alias("n"), F.count(F.lit(1)).alias("hosts")).first()
    per_host = max(1, (total["n"] or 0) // max(1, total["hosts"]))
    # The row travels as one column, so that no name of its own can clash.
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("_host"),
        F.col(f"`{host_col}`").isNull().alias("_no_host"),
    )
    with_lines = attach(
        keyed, hosts, ["_host", "_no_host"], ["_lines"], "_pages", BROADCAST_HASHES // per_host
    )
    text = F.col("_row").getField(text_col).cast("string")
    lines = F.split(text, "\n", -1)
    kept = F.filter(
        lines, lambda x: (_trimmed(x) == "") | ~F.array_contains("_lines", F.xxhash64(_trimmed(x)))
    )
    untouched = F.col("_lines").isNull()
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_kept = F.when(untouched, n_lines).otherwise(F.coalesce(F.size(kept), F.lit(0)).cast("long"))
    zero = F.lit(0).cast("long")
    cleaned = with_lines.select(
        "_row",
        F.when(untouched, text).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.when(text.isNull(), zero).otherwise(n_lines).alias("_n_lines"),
        F.when(text.isNull(), zero).otherwise(n_lines - n_kept).alias("_n_dropped"),
    )
    out = [(F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns]
    if counts:
        out += [F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped")]
    return cleaned.select(*out)
