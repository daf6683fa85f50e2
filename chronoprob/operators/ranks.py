"""Ranks and quantiles of large groups, of which neither a group nor a value that many rows share is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Ranks of a sketch are right within one part in so many of the rows.
ACCURACY = 10_000


def _same(by: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _numbered(rows: DataFrame, part: str, order: Sequence[Column | str], by: Sequence[str], place: str, total: str) -> DataFrame:
    """``rows`` with each row's place, from 1, in its group, from places in the parts and the parts' counts; the
    table of counts is as large as groups and parts."""
    columns = [c for c in rows.columns if c != part]
    counts = rows.groupBy(*by, part).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    starts = counts.select(*by, part, (F.sum("_n").over(group.orderBy(part)) - F.col("_n")).alias("_start"), F.sum("_n").over(group).alias(total)).alias("s")
    ranked = rows.withColumn("_inside", F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))).alias("r")
    both = ranked.join(starts, _same([*by, part], "r", "s"))
    return both.select(*[F.col(f"r.{c}") for c in columns], (F.col("s._start") + F.col("r._inside")).alias(place), F.col(f"s.{total}").alias(total))


def placed(df: DataFrame, unit: Column, order: Sequence[Column | str], by: Sequence[str] = (), place: str = "_place", total: str = "_total") -> DataFrame:
    """``df`` with each row's place, from 1, among the rows that agree in ``by``, and their number. ``unit`` is a hash
    as a number from 0 to 1 that grows along ``order``: its buckets are even, and rows of one are put in order
    together. For values, whose buckets need not be even, there is ``placed_by_value``."""
    bucket = F.coalesce(F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(unit * BUCKETS))).cast("int"), F.lit(BUCKETS))
    return _numbered(df.withColumn("_bucket", bucket), "_bucket", order, by, place, total)


def placed_by_value(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), place: str = "_place", total: str = "_total") -> DataFrame:
    """As ``placed`` for any ``order``: rows are dealt by ranges of (``by``, ``order``), whose limits come from a sample
    of the rows, so that outliers and large groups leave the parts even; an ``order`` that ends in the row's id
    splits what many rows share as well. The dealt rows are a table, so that all uses see the same parts."""
    from chronoprob.sources.observations import cut

    dealt = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    return _numbered(cut(dealt, "ranges"), "_part", order, by, place, total)


def _halves(x: Column) -> tuple[Column, Column]:
    """Two numbers of half the digits that add up to ``x``."""
    high = x * 134217729.0 - (x * 134217729.0 - x)
    return high, x - high


def _between(a: Column, b: Column, share: Column) -> Column:
    """a * (1 - share) + b * share with the first product not rounded, as SQL's ``quantile_cont`` has it: a limit that
    is an ulp off a value that many rows share puts all of them on its other side."""
    x, y, other = a, F.lit(1.0) - share, b * share
    (xh, xl), (yh, yl), product = _halves(x), _halves(y), x * y
    lost = ((xh * yh - product) + xh * yl + xl * yh) + xl * yl
    total = product + other
    back = total - product
    exact = total + (((product - (total - back)) + (other - back)) + lost)
    return F.when(share == 0, a).otherwise(F.nanvl(exact, total))  # numbers near the largest have no halves


def quantiles(p: DataFrame, qs: Sequence[float], interpolate: bool = True, by: Sequence[str] = ("pos",)) -> DataFrame:
    """(by, q): the quantiles of ``v`` for each group, between neighbours in proportion, or, as pairs for each
    quantile, the two neighbours. Null and NaN entries take no part.

    A mergeable sketch gives each quantile a bracket of about six in ACCURACY of the rows, which only has to hold the
    neighbours: a sketch depends on the order in which rows and parts of it meet, so another reading gives another one.
    The brackets are a table, and what lies below, inside and above is counted in one pass. Only values inside
    are shuffled, each once however many rows share it, and the values next to a bracket."""
    from chronoprob.sources.observations import cut

    values = p.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*by, F.col("v").cast("double").alias("v"))
    near = [(max(0.0, q - 3 / ACCURACY), min(1.0, q + 3 / ACCURACY)) for q in qs]
    # a table of known size: where it is small, Spark moves no values for the join
    brackets = cut(values.groupBy(*by).agg(F.percentile_approx("v", [x for pair in near for x in pair], ACCURACY).alias("_e")), "brackets")
    both = values.alias("v").join(brackets.alias("b"), _same(by, "v", "b")) if by else values.join(F.broadcast(brackets))  # one row
    v, low, high = F.col("v"), (lambda i: F.get("_e", F.lit(2 * i))), (lambda i: F.get("_e", F.lit(2 * i + 1)))
    sides = F.array(*[F.struct(F.lit(i).alias("_i"), F.when(v < low(i), -1).when(v > high(i), 1).otherwise(0).alias("_side")) for i in range(len(qs))])
    marked = both.select(*[F.col(f"v.{c}") if by else F.col(c) for c in by], "v", F.explode(sides).alias("_s")).select(*by, "v", "_s._i", "_s._side")
    counted = marked.groupBy(*by, "_i", "_side", F.when(F.col("_side") == 0, v).alias("_at")).agg(F.count("*").alias("_c"), F.min("v").alias("_min"), F.max("v").alias("_max"))
    # what one task puts in order is a bracket: a fixed share of the rows
    own = Window.partitionBy(*by, "_i")
    beside = F.when(F.col("_side") < 0, F.col("_max")).otherwise(F.col("_min"))
    ranked = counted.select(*by, "_i", "_c", beside.alias("v"), F.sum("_c").over(own.orderBy("_side", "_at")).alias("_upto"), F.sum("_c").over(own).alias("_n"))
    pick = lambda i, rank: F.max(F.when((F.col("_i") == i) & (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), v))
    found = []
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.col("_n") - 1)
        found += [pick(i, F.floor(at)).alias(f"_a{i}"), pick(i, F.ceil(at)).alias(f"_b{i}")]
    exact = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *found)
    pairs = [(F.col(f"_a{i}"), F.col(f"_b{i}")) for i in range(len(qs))]
    if not interpolate:
        return exact.select(*by, F.array(*[F.struct(a.alias("low"), b.alias("high")) for a, b in pairs]).alias("q"))
    share = [F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1)) for q in qs]
    return exact.select(*by, F.array(*[_between(a, b, s) for (a, b), s in zip(pairs, share)]).alias("q"))


def grouped_quantile(df: DataFrame, value: str, q: float, by: Sequence[str], name: str) -> DataFrame:
    """(by, name): one interpolated quantile of ``value`` for each group."""
    found = quantiles(df.select(*by, F.col(value).alias("v")), [q], by=by)
    return found.select(*by, F.get("q", F.lit(0)).alias(name))
