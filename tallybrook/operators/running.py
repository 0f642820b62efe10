"""Exact running totals over long orderings without one long window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_totals(
    rows: DataFrame,
    totals: Mapping[str, str],
    order: str,
    bucket: Column,
    group: Sequence[str] = (),
    overall: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add, per new column in `totals`, the sum of a column over all earlier rows of the group.

    `bucket` cuts the ordering into pieces and must never decrease along `order`. Only bucket
    totals meet in one window per group; rows are summed within their bucket, so a group of any
    size spreads over as many tasks as it has buckets. `order` must be unique per group, and
    the columns of `group` not NULL. `overall` adds sums over the whole group likewise.
    """
    overall = overall or {}
    keys = [*group, "_bucket"]
    placed = rows.withColumn("_bucket", bucket)
    whole = W.partitionBy(*group)
    earlier = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = {f"_sum_{c}": F.sum(c) for c in {*totals.values(), *overall.values()}}
    starts = placed.groupBy(*keys).agg(*[s.alias(n) for n, s in sums.items()])
    starts = starts.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_start_{out}")
            for out, c in totals.items()
        ],
        *[F.sum(f"_sum_{c}").over(whole).alias(out) for out, c in overall.items()],
    )
    local = [
        F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_local_{out}")
        for out, c in totals.items()
    ]
    return (
        placed.select("*", *local)
        .join(starts, keys)
        .select(
            *rows.columns,
            *[(F.col(f"_start_{out}") + F.col(f"_local_{out}")).alias(out) for out in totals],
            *overall,
        )
    )


def log_bucket(name: str, per_unit: int = 64) -> Column:
    """Buckets of a number by the logarithm of its size: fine for small, coarse for large values.

    Never decreases along the number and yields at most 2 * 710 * per_unit values for all
    doubles, however many distinct numbers there are.
    """
    x = F.col(name).cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * per_unit)


#: Pieces that the data themselves cut an ordering into.
DATA_PIECES = 64


def data_bucket(rows: DataFrame, name: str) -> Column:
    """Buckets of a number by its size and by where most of the rows lie.

    `log_bucket` alone would leave a narrow range with very many numbers in one task; inside it
    approximate quantiles of the rows at hand cut further. The totals do not depend on the cuts.
    """
    shares = [i / DATA_PIECES for i in range(1, DATA_PIECES)]
    cuts = rows.agg(F.percentile_approx(name, shares, 1000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    piece = F.size(F.filter(bounds, lambda b: b <= F.col(name)))
    return log_bucket(name) * (DATA_PIECES + 1) + piece
