"""Descriptive statistics and the two-sample test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import WEEKDAYS


def six_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum per column, quartiles interpolated linearly.

    Equal values are counted first, so the exact percentiles work on distinct values only.
    """
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value"))
                    for c in cols
                ]
            )
        ).alias("m")
    ).select("m.*")
    counted = long.na.drop().groupBy("measure", "value").agg(F.count("*").alias("n"))
    summary = counted.groupBy("measure").agg(
        F.min("value").alias("minimum"),
        F.percentile("value", [0.25, 0.5, 0.75], F.col("n")).alias("q"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("value").alias("maximum"),
    )
    return summary.select(
        "measure",
        "minimum",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        "mean",
        F.col("q")[2].alias("q3"),
        "maximum",
    )


def mean_sd(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and sample standard deviation per group; nulls are skipped."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def weekday_hour_means(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("weekday", "hour").agg(F.avg(value).alias("mean"))


def weekday_matrix(cells: DataFrame, value: str = "mean") -> DataFrame:
    """Hours as rows, Monday to Sunday as columns."""
    return cells.groupBy("hour").pivot("weekday", WEEKDAYS).agg(F.first(value))


def column_zscores(cells: DataFrame) -> DataFrame:
    """Means standardised within their weekday. Works on the at most 168 cell means."""
    day = Window.partitionBy("weekday")
    z = F.try_divide(
        F.col("mean") - F.avg("mean").over(day), F.stddev_samp("mean").over(day)
    )
    return cells.select("weekday", "hour", z.alias("mean"))


def _simpson(upper: Column, lower: Column, power: Column, panels: int) -> Column:
    """Integral of cos(x)^power by Simpson's rule."""
    width = (upper - lower) / F.lit(panels)

    def term(i: Column) -> Column:
        weight = F.when((i == 0) | (i == panels), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return weight * F.pow(F.greatest(F.cos(lower + i * width), F.lit(0.0)), power)

    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(panels)), F.lit(0.0), lambda acc, i: acc + term(i)
    )
    return total * width / 3.0


def t_two_sided(t: Column, df: Column, panels: int = 2000) -> Column:
    """Two-sided p-value of Student's t, as the tail share of the integral of cos^(df-1).

    Both integrals end where cos^(df-1) falls under e^-42, which is a quarter turn for few degrees of
    freedom and close to 0 for many.
    """
    power = df - 1.0
    low = F.atan(F.abs(t) / F.sqrt(df))
    end = F.acos(F.exp(F.lit(-42.0) / F.greatest(power, F.lit(1e-9))))
    tail = _simpson(F.greatest(end, low), low, power, panels)
    return F.try_divide(tail, _simpson(end, F.lit(0.0), power, panels))


def welch(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """Welch's test of two groups: one row with sizes, means, t, degrees of freedom and p-value.

    Where it is not defined (no variance, or a group of one) the last three are null.
    """
    names = {"1": first, "2": second}
    aggregates = []
    for i, name in names.items():
        x = F.when(F.col(group) == name, F.col(value).cast("double"))
        aggregates += [
            F.count(x).alias("n" + i),
            F.avg(x).alias("mean" + i),
            F.var_samp(x).alias("_var" + i),
        ]
    moments = df.filter(F.col(group).isin(first, second)).agg(*aggregates)
    e1, e2 = F.try_divide("_var1", "n1"), F.try_divide("_var2", "n2")
    freedom = F.try_divide(
        F.pow(e1 + e2, 2.0),
        F.try_divide(F.pow(e1, 2.0), F.col("n1") - 1) + F.try_divide(F.pow(e2, 2.0), F.col("n2") - 1),
    )
    tested = moments.select(
        "n1",
        "n2",
        "mean1",
        "mean2",
        F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2)).alias("t"),
        freedom.alias("df"),
    )
    return tested.withColumn("p_value", t_two_sided(F.col("t"), F.col("df")))
