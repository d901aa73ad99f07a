"""Exact order statistics of groups of any size, by histograms that close in on a rank.

A group's range of values is cut into bins, whose rows are counted by an aggregate that
combines before it shuffles; the one bin that holds a rank is cut again, from its least to its
greatest value, until it has one value or so few rows that they can be sorted together. So
no task ever holds a large group's values, however many of them differ.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize

#: Rows of a bin, or of a group, that one task sorts; bins that a range is cut into; ranges that are broadcast at most.
SMALL, BINS, BROADCAST_ROWS = 1 << 17, 1024, 50_000


def _inside(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows whose value lies in one of their group's ranges, with it."""
    few = ranges.select(F.col("g").alias("of"), "lo", "hi").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    return base.join(few, (F.col("g") == F.col("of")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select("g", "v", "lo", "hi")


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], Column], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """by, n, rank, kth: for each rank (from 0) of ``ranks(n)`` the value at it among a group's ``n`` that aren't null.

    ``ranks`` gives an array for a group's size. Groups are equal where their columns are,
    nulls too. Values are numbers whose range is finite. The passes read a copy of the groups
    and values alone; the result is a table of its own.
    """
    base = materialize(rows.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).alias("v")).filter("v is not null"))
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # at: the rank among the rows of the range; inside: their number.
    live = materialize(sizes.withColumn("rank", F.explode(F.array_distinct(ranks(F.col("n"))))).withColumns({"at": F.col("rank"), "inside": F.col("n")}))
    found = []
    while True:
        found.append(live.filter("lo = hi").select("g", "n", "rank", F.col("lo").alias("kth")))
        few = live.filter(f"lo < hi and inside <= {small}")
        lists = _inside(base, few).groupBy("g", "lo").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
        found.append(few.join(lists, ["g", "lo"]).select("g", "n", "rank", F.element_at("sorted", (F.col("at") + 1).cast("int")).alias("kth")))
        many = live.filter(f"lo < hi and inside > {small}")
        if many.isEmpty():
            break
        share = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
        cut = F.least(F.floor(share * bins), F.lit(bins - 1))
        counted = _inside(base, many).groupBy("g", "lo", cut.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("rows").over(Window.partitionBy("g", "lo").orderBy("bin")) - F.col("rows")
        held = many.join(counted.withColumn("before", before), ["g", "lo"]).filter("at >= before and at < before + rows")
        live = materialize(held.select("g", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), "rank", (F.col("at") - F.col("before")).alias("at"), F.col("rows").alias("inside")))
    every = materialize(reduce(DataFrame.unionByName, found))
    return every.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", "rank", "kth")


def quantiles(rows: DataFrame, by: list[str], values: dict[str, str], probs: list[float], small: int = SMALL) -> DataFrame:
    """by, and for each name of ``values`` the list of exact quantiles of that column, interpolated, as doubles.

    Groups of up to ``small`` rows take Spark's own percentile, which holds their values; larger
    ones are selected by rank. A group without values has null; without ``by`` there is one row.
    """
    base = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), *[F.col(v).alias(n) for n, v in values.items()])
    exact = [F.percentile(n, F.array(*[F.lit(p) for p in probs])).alias(n) for n in values]
    names = [F.col(f"g.{c}").alias(c) for c in by]
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small)
    large = materialize(sizes.select(F.col("g").alias("of")))
    many = large.count()
    if not many:
        whole = base.groupBy("g").agg(*exact) if by else base.agg(*exact)
        return whole.select(*(names if by else []), *values)
    named = F.broadcast(large) if many <= BROADCAST_ROWS else large
    out = base.join(named, F.col("g") == F.col("of"), "left_anti").groupBy("g").agg(*exact)
    # All columns are selected from together, as groups of their own.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(n).cast("double").alias("v")) for k, n in enumerate(values)]))
    part = base.join(named, F.col("g") == F.col("of"), "left_semi").select("g", each.alias("x")).select("g", "x.name", "x.v")
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    both = lambda n: F.array(*[f((n - 1) * F.lit(float(p))).cast("bigint") for p in probs for f in (F.floor, F.ceil)])
    ranked = order_statistics(part, ["g", "name"], "v", both, small).groupBy("g", "name", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "kth"))).alias("at"))
    mixed = []
    for place in places:
        low, high = F.floor(place).cast("bigint"), F.ceil(place).cast("bigint")
        lower, upper = F.col("at")[low], F.col("at")[high]
        mixed.append(F.when(low == high, lower).otherwise((high - place) * lower + (place - low) * upper))
    told = ranked.select(F.col("g").alias("_g"), "name", F.array(*mixed).alias("q"))
    told = told.groupBy("_g").agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(n) for k, n in enumerate(values)])
    wide = large.select(F.col("of").alias("g")).join(told, F.col("g") == F.col("_g"), "left").drop("_g")
    return out.unionByName(wide).select(*(names if by else []), *values)


def smallest_share(rows: DataFrame, by: list[str], key: str, share: float) -> DataFrame:
    """by, limit: the key that the nearest number of rows to ``share`` of each group doesn't exceed.

    Half a row counts as one. Groups from which no row is taken are left out.
    """
    taken = lambda n: F.floor(n * F.lit(share) + 0.5).cast("bigint")
    got = order_statistics(rows, by, key, lambda n: F.when(taken(n) > 0, F.array(taken(n) - 1)).otherwise(F.array().cast("array<bigint>")))
    return got.select(*by, F.col("kth").alias("limit"))
