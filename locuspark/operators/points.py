"""Points, weights, distances and quantiles as DataFrame operators."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.codes import error_probability

DIMS = ["p1", "p2", "p3", "p4"]


def indexed(points: DataFrame, set_: str, order: str) -> DataFrame:
    return points.withColumn("idx", F.row_number().over(Window.partitionBy(set_).orderBy(order)))


def paired_sets(points: DataFrame, set_: str, order: str) -> DataFrame:
    """The points of set s beside those of set s + 1, by index: distance2 and weight."""
    p = indexed(points, set_, order)
    one = p.select(F.col(set_).alias("set1"), "idx", *[F.col(d).alias(f"{d}_1") for d in DIMS], F.col("w").alias("w_1"))
    two = p.select((F.col(set_) - 1).alias("set1"), "idx", *[F.col(d).alias(f"{d}_2") for d in DIMS], F.col("w").alias("w_2"))
    return one.join(two, ["set1", "idx"]).select(
        "set1", "idx", square_distance([F.col(f"{d}_1") for d in DIMS], [F.col(f"{d}_2") for d in DIMS]).alias("d2"), (F.col("w_1") * F.col("w_2")).alias("w")
    )


def square_distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b):
        out = out + (x - y) * (x - y)
    return out


def scaled(distance2: Column) -> Column:
    """A distance on the simplex scaled to [0, 1]."""
    return F.sqrt(distance2) / F.lit(sqrt(2))


def long_form(points: DataFrame, *keep: str) -> DataFrame:
    """One row a dimension: keep, dim (from 1), x."""
    return points.select(*keep, F.posexplode(F.array(*DIMS)).alias("d0", "x")).withColumn("dim", F.col("d0") + 1).drop("d0")


def rank_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """keys, q, value: the element of rank round(q n) from 0; 0.0 where that is n."""
    ranked = df.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(value)).cast("long").alias("rank_"))
    wanted = df.groupBy(*keys).agg(F.count("*").alias("n_")).withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    wanted = wanted.withColumn("rank_", F.floor(F.col("q") * F.col("n_") + 0.5) + 1)
    return wanted.join(ranked, [*keys, "rank_"], "left").select(*keys, "q", F.coalesce(value, F.lit(0.0)).alias(value))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """keys, q, value: the first value whose preceding weight reaches q of the whole, or the last."""
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = df.select(*keys, value, weight, F.coalesce(F.sum(weight).over(before), F.lit(0.0)).alias("before_"))
    whole = df.groupBy(*keys).agg(F.sum(weight).alias("whole_"), F.max(value).alias("last_"))
    joined = run.join(whole, keys)
    firsts = joined.groupBy(*keys).agg(
        F.first("last_").alias("last_"), *[F.min(F.when(F.col("before_") >= q * F.col("whole_"), F.col(value))).alias(f"q{i}_") for i, q in enumerate(quantiles)]
    )
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.coalesce(f"q{i}_", "last_").alias(value)) for i, q in enumerate(quantiles)])
    return firsts.select(*keys, F.inline(pairs))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def log_likelihood(points: list[Column], terms: list[tuple[int, int, int]]) -> Column:
    """Sum over (base index, quality, count) of count * ln(probability of the call at a point)."""
    out = F.lit(0.0)
    for base, qual, ct in terms:
        e = error_probability(F.lit(float(qual)))
        p = F.lit(0.0)
        for i, x in enumerate(points):
            p = p + x * ((1 - e) if i == base else e / 3)
        out = out + ct * F.ln(p)
    return out


def log_ratio(points: list[Column], terms: list[tuple[int, int, int]], counts: list[int], prior: float, residual: str = "compat") -> Column:
    out = log_likelihood(points, terms)
    for x, c in zip(points, counts):
        out = out - F.ln(x) * (c - (prior if residual == "compat" else 0.0))
    return out


def scaled_exponent(df: DataFrame, key: str, logs: str) -> DataFrame:
    """exp(logs - the key's largest)."""
    top = df.groupBy(key).agg(F.max(logs).alias("top_"))
    return df.join(top, key).withColumn("weight", F.exp(F.col(logs) - F.col("top_"))).drop("top_")


def log2_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    top = df.groupBy(key).agg(F.max(value).alias("top_"))
    summed = df.join(top, key).groupBy(key).agg(F.first("top_").alias("top_"), F.sum(F.pow(F.lit(2.0), F.col(value) - F.col("top_"))).alias("s_"))
    return summed.select(key, (F.log2("s_") + F.col("top_")).alias("log2_sum"))


def log2_running(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Log of the running sum, kept in range by the key's largest value."""
    w = Window.partitionBy(key)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(value).over(w)
    return df.withColumn("top_", top).withColumn("log2_running", F.log2(F.sum(F.pow(F.lit(2.0), F.col(value) - F.col("top_"))).over(run)) + F.col("top_")).drop("top_")


def step_bounds(df: DataFrame, key: str, x: str, log2y: str) -> DataFrame:
    """Log of the running area under the upper and lower step functions of a curve."""
    order = Window.partitionBy(key).orderBy(x)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    y0, x0 = F.lag(log2y).over(order), F.lag(x).over(order)
    areas = df.select(key, x, F.greatest(log2y, y0).alias("hi_"), F.least(log2y, y0).alias("lo_"), F.log2(F.col(x) - x0).alias("dx_"), y0.alias("y0_")).where("y0_ is not null")
    total = lambda side: F.log2(F.sum(F.pow(F.lit(2.0), F.col(side) + F.col("dx_"))).over(run))
    return areas.select(key, x, total("hi_").alias("upper"), total("lo_").alias("lower"))


def state(lo: Column, hi: Column, confidence: float) -> Column:
    """changed, ambiguous, unchanged or a mixture, from the bounds of the unchanged proportion."""
    def tag(b: Column) -> Column:
        return F.when(F.lit(confidence) < b, 2).when(F.lit(1 - confidence) < b, 1).otherwise(0)

    a, b = tag(lo), tag(hi)
    return (
        F.when(a > b, F.raise_error(F.lit("bounds cross")).cast("string"))
        .when((a == b) & (a == 0), "changed").when((a == b) & (a == 1), "ambiguous").when(a == b, "unchanged")
        .when(a == 0, "ambiguous_or_changed").otherwise("ambiguous_or_unchanged")
    )


def convolve(a: Column, b: Column) -> Column:
    """Discrete convolution of two arrays."""
    n = F.size(a) + F.size(b) - 1
    term = lambda k: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(a, i) * F.get(b, k - i), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), n - 1), term)


def in_simplex(point: Column) -> Column:
    """Whether an array is on or below the simplex: none below 0, a sum of 1 at most, but for rounding."""
    total = F.aggregate(point, F.lit(0.0), lambda s, x: s + x)
    return F.forall(point, lambda x: x >= 0) & (total <= 1 + 1e-10)


def weight_spread(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """keys, least, most, total, and most over the mean weight."""
    ratio = F.max(weight) / F.sum(weight) * F.count(weight)
    return df.groupBy(*keys).agg(F.min(weight).alias("least"), F.max(weight).alias("most"), F.sum(weight).alias("total"), ratio.alias("most_to_mean"))


def boundary_distance(point: Column, dims: int) -> Column:
    """Distance of a composition to the simplex's boundary, from its least component."""
    # How far a unit of the least component is, by the number of components.
    scale = {2: 1.0, 3: sqrt(1.5), 4: 2 * sqrt(3) / 3}[dims]
    return F.array_min(point) * scale


def local_mass(points: DataFrame, dims: list[str], weight: str, neighbours: int, cell: float) -> DataFrame:
    """center, volume, weight, mass: the cube around each point's neighbours times its weight.

    points: id, dims, weight. A point counts if it has `neighbours` others within the distance to
    the boundary, and volume is the cube of the distance to the last of them. Neighbours come
    from a join on grid cells of width `cell`, the largest distance that is looked at.
    """
    at = [F.floor(F.col(d) / cell) for d in dims]
    one = points.select("id", *dims, weight, F.array(*at).alias("cell_"))
    near = one
    for i in range(len(dims)):
        near = near.withColumn(f"s{i}_", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    near = near.select("id", *dims, weight, F.array(*[F.col("cell_")[i] + F.col(f"s{i}_") for i in range(len(dims))]).alias("cell_"))
    other = one.select(F.col("id").alias("other"), *[F.col(d).alias(f"{d}_o") for d in dims], "cell_")
    d2 = square_distance([F.col(d) for d in dims], [F.col(f"{d}_o") for d in dims])
    reach = F.least(boundary_distance(F.array(*dims), len(dims)), F.lit(cell))
    met = near.join(other, "cell_").where("id <> other").withColumn("d_", F.sqrt(d2)).where(F.col("d_") <= reach)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d_", "other"))
    last = met.withColumn("k_", rank).where(F.col("k_") == neighbours)
    volume = F.pow("d_", F.lit(3.0))
    return last.select(F.col("id").alias("center"), volume.alias("volume"), F.col(weight).alias("weight"), (volume * F.col(weight)).alias("mass"))


def trimmed_mean_and_median(df: DataFrame, values: list[str], low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Per value: the mean of the sorted elements from rank floor(n low) to before floor(n high) - 1, and element n / 2."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("x")) for v in values])))
    ranked = long.withColumns({"k": F.row_number().over(Window.partitionBy("metric").orderBy("x")) - 1, "n": F.count("*").over(Window.partitionBy("metric"))})
    inside = (F.col("k") >= F.floor(F.col("n") * low)) & (F.col("k") < F.floor(F.col("n") * high) - 1)
    middle = F.col("k") == F.floor(F.col("n") / 2)
    return ranked.groupBy("metric").agg(F.avg(F.when(inside, F.col("x"))).alias("mean"), F.max(F.when(middle, F.col("x"))).alias("median"))


def adjusted_bound(bound: Column, wins: Column, trials: Column, win_weight: Column, loss_weight: Column) -> Column:
    """A bound of a proportion corrected by the mean weights of successes and failures."""
    hi, lo = win_weight / wins, loss_weight / (trials - wins)
    return F.when((wins == 0) | (wins == trials), bound).otherwise(hi * bound / (lo * (1 - bound) + hi * bound))


def running_share(df: DataFrame, key: str, order: str, weight: str, inside: Column) -> DataFrame:
    """df with share, the weight of rows `inside` among all weight up to each row."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.sum(F.when(inside, F.col(weight)).otherwise(0.0)).over(run)
    return df.withColumn("share", mine / F.sum(weight).over(run))


def accepted_at(df: DataFrame, key: str, order: str, weight: str, inside: Column, enough: float) -> DataFrame:
    """key and the first place in the order where the running share exceeds `enough`."""
    return running_share(df, key, order, weight, inside).where(F.col("share") > enough).groupBy(key).agg(F.min(order).alias("accepted_at"))


def normalised_densities(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """df with own and other divided by the key's mean of 1 / own: importance weights of drawn points."""
    norm = df.groupBy(key).agg(F.avg(1 / F.col(own)).alias("norm_"))
    return df.join(norm, key).withColumns({own: F.col(own) / F.col("norm_"), other: F.col(other) / F.col("norm_")}).drop("norm_")


def smooth_points(df: DataFrame, key: str, weight: str, times: float) -> DataFrame:
    """Rows whose weight is below `times` the key's mean weight."""
    mean = df.groupBy(key).agg(F.avg(weight).alias("mean_"))
    return df.join(mean, key).where(F.col(weight) < times * F.col("mean_")).drop("mean_")
