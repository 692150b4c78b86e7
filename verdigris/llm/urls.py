"""URL filtering by path-template trees.

Each host has a tree of path segments. Level by level, from the root, a segment
turns into the wildcard * where it looks variable (numbers, hexadecimal, UUIDs,
dates). Of the other branches, those with enough labelled pages whose rate of bad
ones doesn't differ significantly from that of all other branches of their
node are merged into the branch ~. A branch with too few labels says nothing of its
likeness: it keeps its name, unless its node's names hardly ever repeat (fewer
than two pages a branch), which makes them a variable too. No width of a
node changes these rules. A page's template is its path through the tree.
A template is rejected if its share of bad pages, smoothed towards the share
of the whole table, reaches a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable

DEPTH = 6
VARIABLE = r"(?i)^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|.*[0-9]{4,}.*)$"
#: Squared z-score up to which a branch is like the others of its node.
LIKE = 3.84
#: Weight of the table's share in a template's, labelled pages and share from which it is rejected.
SMOOTH, LEAST, REJECT = 5.0, 5, 0.4


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, segs)``: host in lower case without port, user, www. or
    m.; up to ``DEPTH`` path segments, the rest joined to the last; query,
    fragment, closing slash and .htm(l) are dropped. URLs without a host have a
    null host and no segments."""
    rest = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    host = F.regexp_replace(F.regexp_extract(F.lower("rest"), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1), r"(?i)\.html?$", ""), r"^/+|/+$", "")
    segs = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/+", DEPTH))
    return (
        pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
        .withColumn("rest", rest).withColumn("host", F.nullif(host, F.lit(""))).withColumn("path", path)
        .select("page_id", "host", F.when(F.col("host").isNull(), F.array().cast("array<string>")).otherwise(segs).alias("segs"))
    )


def templates(paths: DataFrame) -> DataFrame:
    """``(host, segs, template)`` for distinct paths with ``pages, labelled, bad``.

    One aggregation a level over distinct paths, which are far fewer than pages;
    every node is decided by counts of its branches alone."""
    at = paths.withColumn("template", F.lit(""))
    for level in range(DEPTH):
        seg = F.get("segs", F.lit(level))
        here = at.withColumn("seg", seg).withColumn("variable", F.col("seg").rlike(VARIABLE))
        branch = here.where("seg IS NOT NULL").groupBy("host", "template", "seg", "variable").agg(F.sum("pages").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        branch = durable(branch)
        # combined before it moves: a hot host's node is one row
        node = branch.where("NOT variable").groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("n").alias("node_pages"), F.sum("labelled").alias("node_labelled"), F.sum("bad").alias("node_bad")
        )
        decided = branch.join(node, ["host", "template"], "left")
        # z² of the branch's bad pages against those of the node's other branches,
        # in whole numbers: (bad·N - B·n)² · N against LIKE · n · (N - n) · B · (N - B)
        n, b, all_n, all_b = (F.col(c).cast("double") for c in ("labelled", "bad", "node_labelled", "node_bad"))
        off = b * all_n - all_b * n
        like = off * off * all_n <= LIKE * n * (all_n - n) * all_b * (all_n - all_b)
        enough = F.col("labelled") >= LEAST
        several = F.col("children") > 1
        name = (
            F.when(F.col("variable"), "*").when(several & enough & like, "~")
            .when(several & ~enough & (2 * F.col("children") > F.col("node_pages")), "*").otherwise(F.col("seg"))
        )
        named = decided.select("host", "template", "seg", name.alias("name"))
        joined = here.join(named, ["host", "template", "seg"], "left")
        at = durable(
            joined.select("host", "segs", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"), "pages", "labelled", "bad")
        )
        if at.where(F.size("segs") > level + 1).isEmpty():
            break
    return at


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, template, labelled, bad, share, rejected)`` for every page.

    ``labels`` has ``page_id`` and ``bad`` (0 or 1); nulls in either are unlabelled,
    and a page that is labelled more than once is bad if any label says so. Pages
    without a host have a null template, no counts and aren't rejected; so do null URLs. The root path's
    template is '/'. Rows that repeat a page are each counted. An empty table gives an empty one.
    Segments beyond ``DEPTH`` are one.
    """
    urls = split_urls(pages, id_col, url_col)
    marks = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.max(F.col("bad").cast("bigint")).alias("bad"))
    rows = durable(urls.join(marks, "page_id", "left"))
    paths = durable(rows.where("host IS NOT NULL").groupBy("host", "segs").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    named = templates(paths)
    prior = paths.agg((F.coalesce(F.sum("bad"), F.lit(0)).cast("double") / F.greatest(F.sum("labelled"), F.lit(1))).alias("prior"))
    totals = named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(prior))
    share = (F.col("bad") + SMOOTH * F.col("prior")) / (F.col("labelled") + SMOOTH)
    judged = totals.select("host", "template", "labelled", "bad", F.round(share, 6).alias("share"), ((F.col("labelled") >= LEAST) & (share >= REJECT)).alias("rejected"))
    by_path = durable(named.select("host", "segs", "template").join(judged, ["host", "template"]))
    out = rows.drop("bad").join(by_path, ["host", "segs"], "left")
    return out.select(
        "page_id", "host", F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template")).alias("template"),
        "labelled", "bad", "share", F.coalesce("rejected", F.lit(False)).alias("rejected"),
    )
