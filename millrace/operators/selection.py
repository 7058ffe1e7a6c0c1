"""Exact percentiles by refining ranges: no task ever holds the distinct values of a group.

A percentile is the value of one or two ranks. A pass brackets each rank: a quantile sketch of bounded size gives a value a little
below and one a little above; exact counts then say how many rows are below, equal to and between them. A rank that falls on an
end is settled, however many rows share that value. Else only the rows strictly between stay, three in a thousand of them or so,
and the next pass looks among those. What is left of a group is sorted when it has LAST rows at most. If a sketch should
miss, which the counts show, the next bracket is what lies beyond on that side, so no rank is ever lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..storage import staged
from ..tables import table

#: The sketch's accuracy: ranks are off by one in so many rows at most. Its steps. Rows of a bracket that are sorted in the end.
ACCURACY, STEPS, LAST = 10_000, 1_024, 20_000
#: Rows of targets (a group's key, two values, two counts) that may be broadcast.
BROADCAST_ROWS = 50_000


def _near(targets: DataFrame) -> DataFrame:
    """targets is staged: one row for each open group and rank."""
    return F.broadcast(targets) if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else targets


def select_ranks(rows: DataFrame, targets: DataFrame, accuracy: int = ACCURACY, last: int = LAST) -> DataFrame:
    """g, k, v: the k-th smallest (from 0) value of each group, exactly. rows: g, v (doubles, no nulls); targets: g, k with 0 <= k <
    the group's rows. g has no nulls."""
    done: list[DataFrame] = []
    open_ = staged(targets.select("g", "k", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below")), "select-targets")
    bracket = ("g", "low", "high", "below")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a["g"] == b["g"]) & a["low"].eqNullSafe(b["low"]) & a["high"].eqNullSafe(b["high"]) & (a["below"] == b["below"])

    while open_.limit(1).count():
        # rows strictly inside each open bracket, once for all of its ranks
        inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
        left = rows.join(_near(staged(open_.select(*bracket).distinct(), "select-open")), "g").where(inside)
        rough = F.percentile_approx("v", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), accuracy)
        sizes = staged(left.groupBy(*bracket).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), rough.alias("rough")), "select-sizes")
        sized = open_.join(sizes, same(open_, sizes)).select(open_["*"], "n", "least", "most", "rough")
        few = sizes.where(F.col("n") <= last)
        if few.limit(1).count():
            near = _near(staged(few.select(*bracket), "select-few"))
            rest = left.join(near, same(left, near), "left_semi")
            ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy(*bracket).orderBy("v")) - 1 + F.col("below"))
            asked = _near(staged(sized.where(F.col("n") <= last).select("k", *bracket), "select-asked"))
            done.append(staged(ranked.join(asked, same(ranked, asked) & (ranked["r"] == asked["k"])).select(asked["g"], "k", "v"), "select-done"))
        many = sized.where(F.col("n") > last)
        if not many.limit(1).count():
            break
        # the stretch of the rough quantiles around the rank, one step wider for what the sketch may be off
        step = F.floor((F.col("k") - F.col("below")) / F.col("n") * STEPS).cast("int")
        low, high = F.element_at("rough", F.greatest(step, F.lit(1))), F.element_at("rough", F.least(step + 3, F.lit(STEPS + 1)))
        cut = staged(many.select("g", "k", "low", "high", "below", F.coalesce(low, "least").alias("a"), F.coalesce(high, "most").alias("b")), "select-brackets")
        v = F.col("v")
        counts = [F.count_if(c).alias(n) for n, c in (("n_below", v < F.col("a")), ("n_a", v == F.col("a")), ("n_in", (v > F.col("a")) & (v < F.col("b"))), ("n_b", v == F.col("b")))]
        inner = rows.join(_near(cut), "g").where(inside)
        counted = inner.groupBy("g", "k", "low", "high", "below", "a", "b").agg(*counts)
        at = F.col("k") - F.col("below")
        n_to_a, n_to_in = F.col("n_below") + F.col("n_a"), F.col("n_below") + F.col("n_a") + F.col("n_in")
        where = F.when(at < F.col("n_below"), "missed").when(at < n_to_a, "a").when(at < n_to_in, "in").when((at < n_to_in + F.col("n_b")) & (F.col("a") < F.col("b")), "b").otherwise("missed")
        counted = staged(counted.withColumn("where", where), "select-counted")
        done.append(counted.where(F.col("where").isin("a", "b")).select("g", "k", F.when(F.col("where") == "a", F.col("a")).otherwise(F.col("b")).alias("v")))
        narrow = counted.where("where = 'in'").select("g", "k", F.col("a").alias("low"), F.col("b").alias("high"), (F.col("below") + n_to_a).alias("below"))
        missed = counted.where("where = 'missed'")
        # beyond the bracket: what is below a, or above b, within the old one
        under = F.col("k") - F.col("below") < F.col("n_below")
        missed = missed.select("g", "k", F.when(under, F.col("low")).otherwise(F.col("b")).alias("low"), F.when(under, F.col("a")).otherwise(F.col("high")).alias("high"), F.when(under, F.col("below")).otherwise(F.col("below") + n_to_in + F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(0)).alias("below"))
        open_ = staged(narrow.unionByName(missed), "select-targets")
    out = None  # a rank is settled once: where it is found, its bracket closes
    for part in done:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else targets.select("g", "k", F.lit(None).cast("double").alias("v")).limit(0)


def exact_percentiles(df: DataFrame, by: list[str], column: str, shares: list[float], accuracy: int = ACCURACY, last: int = LAST) -> DataFrame:
    """The columns of by, n (rows with a value), and, for each share, p0, p1, ...: the interpolated percentile, as percentile_cont, in
    doubles; and d0, d1, ...: the least value with at least that share of rows up to it, as percentile_disc.

    Nulls don't count; a group of nulls alone has nulls. Groups may have null keys. NaN is the greatest value.
    """
    base = df.select(F.struct(*by).alias("g") if by else F.struct(F.lit(1).alias("one")).alias("g"), F.col(column).cast("double").alias("v"))
    groups = staged(base.groupBy("g").agg(F.count("v").alias("n")).withColumn("id", F.monotonically_increasing_id()), "percentile-groups")
    # keys become numbers, so that a null in a key is no null key
    known = F.broadcast(groups) if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else groups
    rows = base.where("v IS NOT NULL").join(known.select(F.col("g").alias("known"), "id"), F.col("g").eqNullSafe(F.col("known"))).select(F.col("id").alias("g"), "v")

    def ranks(share: float) -> dict[str, Column]:
        place = F.lit(share) * (F.col("n") - 1)
        disc = F.greatest(F.ceil(F.lit(share) * F.col("n")) - 1, F.lit(0))
        return {"lo": F.floor(place), "hi": F.ceil(place), "d": disc.cast("long")}

    wanted = groups.where("n > 0").select(F.col("id").alias("g"), F.explode(F.array_distinct(F.array(*[c.cast("long") for s in shares for c in ranks(s).values()]))).alias("k"))
    found = select_ranks(rows, wanted, accuracy, last)
    by_group = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).withColumnRenamed("g", "id")  # a few ranks
    joined = groups.join(by_group, "id", "left")
    out = [F.col(f"g.{c}").alias(c) for c in by] + ["n"]
    for i, s in enumerate(shares):
        at = {name: F.col("m")[c.cast("long")] for name, c in ranks(s).items()}
        rest = F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))
        out += [F.when(rest == 0, at["lo"]).otherwise((1 - rest) * at["lo"] + rest * at["hi"]).alias(f"p{i}"), at["d"].alias(f"d{i}")]
    return joined.select(*out)


@query("SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS middle, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS p99, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS q1 FROM lineitem GROUP BY l_returnflag")
def agg_percentile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of prices, nearly all of them different."""
    p = exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.99, 0.25], last=2_000)
    return p.select("l_returnflag", F.round("p0", 6).alias("middle"), F.round("p1", 6).alias("p99"), F.col("d2").alias("q1"))


@query("SELECT median(l_quantity) AS quantity FROM lineitem")
def agg_median_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a column of few values, over the whole table."""
    return exact_percentiles(table(spark, sf_dir, "lineitem"), [], "l_quantity", [0.5], last=2_000).select(F.col("p0").alias("quantity"))
