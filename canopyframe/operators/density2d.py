"""The numbers behind a hexagon plot and a two-dimensional density plot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.ranking import exact_quantiles

_MARGIN = 1e-6


def hexagon_counts(points: DataFrame, bins: int = 30) -> DataFrame:
    """Counts per hexagon: (``hex_x``, ``hex_y``) is the centre, ``count`` the points in it.

    Hexagons are the cells of two interleaved rectangular lattices; a point belongs to the nearer
    centre. Cell widths are the data ranges over ``bins``.
    """
    ends = points.agg(F.struct(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
        F.max("y").alias("y1"))).scalar()
    placed = points.withColumn("_e", ends)
    # Lattice units: columns one cell wide, rows sqrt(3) cells apart.
    for axis, spread in (("x", 1.0), ("y", float(np.sqrt(3.0)))):
        low, high = F.col(f"_e.{axis}0"), F.col(f"_e.{axis}1")
        width = F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0))
        placed = (
            placed.withColumn(f"_b{axis}", F.floor(low / width) * width - _MARGIN)
            .withColumn(f"_c{axis}", 1 / (width * F.lit(spread)))
            .withColumn(f"_s{axis}", F.col(f"_c{axis}") * (F.col(axis) - F.col(f"_b{axis}")))
        )

    def square(c: Column) -> Column:
        return c * c

    jx, jy = F.floor(F.col("_sx") + 0.5), F.floor(F.col("_sy") + 0.5)
    kx, ky = F.floor("_sx") + 0.5, F.floor("_sy") + 0.5
    first = square(F.col("_sx") - jx) + 3 * square(F.col("_sy") - jy)
    second = square(F.col("_sx") - kx) + 3 * square(F.col("_sy") - ky)
    near = first <= second
    # Doubled lattice indices are whole numbers on both lattices, hence exact group keys.
    return (
        placed.select(
            F.when(near, 2 * jx).otherwise((2 * kx).cast("long")).alias("_i"),
            F.when(near, 2 * jy).otherwise((2 * ky).cast("long")).alias("_j"),
            "_bx", "_by", "_cx", "_cy")
        .groupBy("_i", "_j", "_bx", "_by", "_cx", "_cy").agg(F.count(F.lit(1)).alias("count"))
        .select((F.col("_bx") + F.col("_i") / 2 / F.col("_cx")).alias("hex_x"),
                (F.col("_by") + F.col("_j") / 2 / F.col("_cy")).alias("hex_y"), "count")
    )


def kernel_bandwidth(sd: float, q1: float, q3: float, n: int) -> float:
    """Normal-reference bandwidth (standard deviation of the kernel)."""
    width = 1.06 * min(sd, (q3 - q1) / 1.34) * n ** -0.2
    if not width > 0:
        raise ValueError("a bandwidth is zero: the quartiles of one variable coincide")
    return width


def kernel_density(points: DataFrame, n: int = 75) -> DataFrame:
    """Gaussian product-kernel density on an ``n`` by ``n`` grid over the data range.

    Every task reduces its points to one n x n matrix with a matrix product; the matrices are
    added per cell. What is shuffled is n * n numbers per task, independent of the data size.
    Repeated points, such as pairs of years, are counted once per batch.
    """
    row = points.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
                     F.min("y").alias("y0"), F.max("y").alias("y1"),
                     F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")).first()
    quartiles = {"q1": 0.25, "q3": 0.75}
    qx = exact_quantiles(points, [], "x", quartiles).first()
    qy = exact_quantiles(points, [], "y", quartiles).first()
    hx = kernel_bandwidth(row.sx, qx.q1, qx.q3, row.n)
    hy = kernel_bandwidth(row.sy, qy.q1, qy.q3, row.n)
    gx = np.linspace(row.x0, row.x1, n)
    gy = np.linspace(row.y0, row.y1, n)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if total is None:
                total = np.zeros((n, n))
            spots = pdf.groupby(["x", "y"], as_index=False).size()
            ax = np.exp(-0.5 * ((gx[:, None] - spots["x"].to_numpy()[None, :]) / hx) ** 2)
            ay = np.exp(-0.5 * ((gy[:, None] - spots["y"].to_numpy()[None, :]) / hy) ** 2)
            total += (ax * spots["size"].to_numpy()[None, :]) @ ay.T
        if total is None:
            return
        i, j = np.indices((n, n))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "part": total.ravel()})

    scale = 1.0 / (row.n * hx * hy * 2 * float(np.pi))
    step_x, step_y = (row.x1 - row.x0) / (n - 1), (row.y1 - row.y0) / (n - 1)
    return (
        points.select("x", "y").mapInPandas(partial, "i int, j int, part double")
        .groupBy("i", "j").agg((F.sum("part") * F.lit(scale)).alias("density"))
        .select((F.lit(row.x0) + F.col("i") * F.lit(step_x)).alias("x"),
                (F.lit(row.y0) + F.col("j") * F.lit(step_y)).alias("y"), "density")
    )
