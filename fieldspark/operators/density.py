"""Density curves: binned Gaussian kernel estimates, before and after cleaning.

Rows are read twice, whatever their number: once for count, spread and range of each column and state,
once to bin them (each value is shared between its two grid points by distance). The kernel then
works on GRID counts a curve, as a join of the grid with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) --------------------------------------
GRID = 200  # points of a curve
CUT = 3  # bandwidths that a curve goes beyond the least and greatest value


def density(values: DataFrame, grid: int = GRID, cut: float = CUT) -> DataFrame:
    """state, column, point (from 0), x, density of ``values`` (state, column, v), nulls left out.

    Bandwidth by Scott's rule, sample deviation times n to the power of -1/5. A curve needs two
    different values; other columns have none.
    """
    rows = values.where(F.col("v").isNotNull())
    keys = ["state", "column"]
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")).where("sd > 0")
    fit = fit.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    fit = fit.withColumn("at", F.col("lo") - cut * F.col("h"))
    fit = fit.withColumn("step", (F.col("hi") + cut * F.col("h") - F.col("at")) / (grid - 1)).select(*keys, "n", "h", "at", "step")
    fit = F.broadcast(fit)  # a row for each column and state
    place = rows.join(fit, keys).withColumn("u", (F.col("v") - F.col("at")) / F.col("step")).withColumn("i", F.least(F.floor("u"), F.lit(grid - 2)))
    part = F.col("u") - F.col("i")
    near = F.explode(F.array(F.struct(F.col("i").alias("i"), (1 - part).alias("w")), F.struct((F.col("i") + 1).alias("i"), part.alias("w"))))
    bins = place.select(*keys, near.alias("b")).groupBy(*keys, "b.i").agg(F.sum("b.w").alias("w"))
    points = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("point") - F.col("i")) * F.col("step") / F.col("h")
    curve = points.join(bins, keys).groupBy(*keys, "point", "n", "h", "at", "step").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("k"))
    height = F.col("k") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return curve.select(*keys, "point", (F.col("at") + F.col("point") * F.col("step")).alias("x"), height.alias("density"))


def density_before_after(before: DataFrame, after: DataFrame, cols: list[str], grid: int = GRID) -> DataFrame:
    """``density`` of each column before and after cleaning."""
    def long(df: DataFrame, state: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
        return df.select(F.lit(state).alias("state"), F.explode(each).alias("r")).select("state", "r.*")

    return density(long(before, "before").unionByName(long(after, "after")), grid)
