"""Mixing sources to target weights by hash-threshold histograms.

Each document has a uniform 60-bit hash of its id. A source's budget of tokens
is met by keeping its documents below a threshold hash. The threshold is found
without sorting: tokens are summed by source and by the hash's leading 12 bits,
the bucket in which the running sum passes the budget is the boundary, and only
the documents of boundary buckets are summed again by the next 12 bits, until
the bits run out or no budget falls inside a bucket. Budgets of growing size share the hash order, so the
document sets that they keep are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, fresh, key_hash

BITS, DIGIT = 60, 12
#: Nested budgets of the query, as shares of the corpus's tokens.
BUDGETS = (0.1, 0.3, 0.6)
#: Sources weigh their tokens to this power: below 1, small sources gain.
POWER = 0.5


def count_tokens(text: Column) -> Column:
    """Runs of characters other than blanks; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def keyed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, tokens, h)``; a null source is a source of its own, ''.
    Rows with a null id are left out; rows that repeat an id share its hash."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        count_tokens(F.col(text_col)).alias("tokens"),
        key_hash(F.col(id_col)).alias("h"),
    ).where("doc_id IS NOT NULL")


def budgets(totals: DataFrame, shares: tuple[float, ...] = BUDGETS, weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """``(source, tier, budget)`` from ``(source, total)``.

    A tier's tokens, its share of the corpus, are divided in proportion to the
    sources' weights (given, or total to a power). A source that has fewer than
    its part gives all it has and the others divide the rest (water-filling):
    sources are taken in order of total per weight, and the level is the first
    at which the remaining sources can all pay. Sources without a weight get
    nothing. Works on one row a source and tier.
    """
    weigh = F.pow(F.col("total").cast("double"), F.lit(float(power)))
    if weights is not None:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.map_from_arrays(F.array(), F.array())
        weigh = F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    # weights are whole numbers, so that their sums are exact
    rows = totals.withColumn("weight", F.round(weigh * 1000).cast("bigint")).where("weight > 0 AND total > 0")
    goal = totals.agg(F.sum("total").alias("corpus"))
    tiers = goal.select("corpus", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("tier", "share"))
    tiers = tiers.select((F.col("tier") + 1).alias("tier"), F.floor(F.col("corpus") * F.col("share")).cast("bigint").alias("goal"))
    by_ratio = Window.partitionBy("tier").orderBy((F.col("total") / F.col("weight")).asc(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        rows.crossJoin(tiers)
        .withColumn("paid", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(Window.partitionBy("tier")) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # this source and all after it can pay their parts of what is left
        .withColumn("level", F.when((F.col("goal") - F.col("paid")) * F.col("weight").cast("double") <= F.col("total").cast("double") * F.col("rest"), (F.col("goal") - F.col("paid")) / F.col("rest")))
        .withColumn("level", F.max("level").over(Window.partitionBy("tier")))  # levels fall after the first
    )
    part = F.when(F.col("level").isNull(), F.col("total")).otherwise(F.least(F.col("total"), F.floor(F.col("level") * F.col("weight")).cast("bigint")))
    return spread.select("source", "tier", F.greatest(part, F.lit(0)).cast("bigint").alias("budget"))


def thresholds(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, tier, below)``: a document of the source is in the tier if its
    hash is less than ``below``. The tokens kept are the most that a threshold
    can keep within the budget; documents with one hash are kept or not together.
    ``docs`` has source, h and tokens, and is read once per digit of the hash.
    """
    # each open boundary: documents with h >> shift == prefix, 'left' tokens still free
    boundary = wanted.select("source", "tier", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    settled = None
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        # a source's tiers may share a boundary bucket: its documents are summed once
        open_ = boundary.select("source", "prefix").distinct()
        rows = docs.select("source", "tokens", F.shiftright("h", shift + DIGIT).alias("prefix"), F.shiftright("h", shift).alias("bucket"))
        sums = rows.join(open_, ["source", "prefix"], "left_semi").groupBy("source", "prefix", "bucket").agg(F.sum("tokens").alias("tokens"))
        running = Window.partitionBy("source", "tier").orderBy("bucket")
        after = sums.join(boundary, ["source", "prefix"]).withColumn("upto", F.sum("tokens").over(running))
        # the first bucket that passes the budget; none does if the whole prefix fits
        passed = after.where("upto > left").groupBy("source", "tier").agg(F.min_by(F.struct("bucket", "upto", "tokens"), "bucket").alias("b"))
        step = boundary.join(passed, ["source", "tier"], "left").select(
            "source", "tier",
            F.when(F.col("b").isNotNull(), F.col("left") - (F.col("b.upto") - F.col("b.tokens"))).alias("left"),
            F.col("b.bucket").alias("prefix"),
            F.shiftleft(F.coalesce(F.col("b.bucket"), F.shiftleft(F.col("prefix") + 1, DIGIT)), shift).alias("below"),
        )
        step = durable(step)
        whole = step.where("prefix IS NULL" if shift else "true").select("source", "tier", "below")
        settled = whole if settled is None else settled.unionByName(whole)
        boundary = step.where("prefix IS NOT NULL").select("source", "tier", "left", "prefix")
        if boundary.isEmpty():
            break
    return settled


def mix(docs: DataFrame, shares: tuple[float, ...] = BUDGETS, weights: dict[str, float] | None = None, power: float = POWER,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, tokens, tier)`` of the documents that the largest
    budget keeps; ``tier`` is the first of the nested budgets that does.

    Empty documents cost nothing and follow their hash. Rows that repeat an id
    are each counted, and kept together. Rows with a null id are left out, a null source counts as ''. An
    empty table gives an empty one. Budgets must grow.
    """
    if list(shares) != sorted(shares) or not all(0 < s <= 1 for s in shares):
        raise ValueError("shares must grow, within 0 and 1")
    rows = durable(keyed(docs, id_col, source_col, text_col))
    wanted = durable(budgets(rows.groupBy("source").agg(F.sum("tokens").alias("total")), shares, weights, power))
    cut = thresholds(rows, wanted)
    # one row a source; the optimizer broadcasts it only while it is small
    by_source = durable(cut.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("tier", "below"))).alias("cuts")))
    first = F.expr("aggregate(cuts, CAST(NULL AS INT), (t, c) -> IF(t IS NULL AND h < c.below, c.tier, t))")
    return rows.join(by_source, "source").withColumn("tier", first).where("tier IS NOT NULL").select("doc_id", "source", "tokens", "tier")


def keep_mixed(docs: DataFrame, share: float = BUDGETS[-1], weights: dict[str, float] | None = None, power: float = POWER,
               id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` that one budget keeps; rows with a null id go."""
    rows = durable(keyed(docs, id_col, source_col, text_col))
    wanted = durable(budgets(rows.groupBy("source").agg(F.sum("tokens").alias("total")), (share,), weights, power))
    named, below = fresh(docs, "__source"), fresh(docs, "__below")
    cut = durable(thresholds(rows, wanted)).select(F.col("source").alias(named), F.col("below").alias(below))
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    fits = (source == F.col(named)) & (key_hash(F.col(f"`{id_col}`")) < F.col(below))
    return docs.where(F.col(f"`{id_col}`").isNotNull()).join(cut, fits, "left_semi")
