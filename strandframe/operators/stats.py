"""Tests and summaries over columns, in closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Ranges of values that are ranked side by side; a p value is common if it has more than one in HOT rows.
PARTS, HOT = 64, 256


def counts_before(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """Rows of one distinct value and its count (by, value, n) with ``part``, which ascends with value, and ``before``, the sum
    of n over smaller values of the group.

    Quantiles of each group cut its values into PARTS, whose sums are added up first, so no task sorts a whole group.
    """
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 10_000).alias("__cuts"))
    same = [counts[c].eqNullSafe(cuts[c]) for c in by]
    rows = counts.join(cuts, same).drop(*[cuts[c] for c in by]) if by else counts.crossJoin(F.broadcast(cuts))  # one row
    rows = rows.withColumn("part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    within = F.sum(n).over(Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    # One row a part: at most PARTS a group.
    whole = rows.groupBy(*by, "part").agg(F.sum(n).alias("__n"))
    base = whole.withColumn("__base", F.sum("__n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    rows = rows.withColumn("__within", within)
    rows = rows.join(base, [rows[c].eqNullSafe(base[c]) for c in [*by, "part"]]).drop(*[base[c] for c in [*by, "part"]])
    return rows.withColumn("before", F.coalesce("__base", F.lit(0)) + F.coalesce("__within", F.lit(0))).drop("__base", "__within")


def rank_sum(rows: DataFrame, by: str, group: str, value: str, first: str, second: str) -> DataFrame:
    """Rank-sum z of two groups by `by`, average ranks, no tie correction. Ranks come from counts of distinct values."""
    counts = rows.where(F.col(group).isin(first, second)).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(group) == first, 1)).alias("a"))
    counts = checkpointed(counts)
    rank = F.col("before") + (F.col("n") + 1).cast("double") / 2
    n = counts_before(counts, [by], value).groupBy(by).agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("n") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * rank).alias("w"))
    n1, n2 = F.col("n1"), F.col("n2")
    z = (F.col("w") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return n.select(by, F.when((n1 > 0) & (n2 > 0), z).alias("z"))


def normal_p(z):
    """Two-sided p of a standard normal: erfc by a rational approximation, good to 1.2e-7."""
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = F.lit(1.0) / (F.lit(1.0) + 0.5 * x)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)  # fixed values
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def stars(p):
    """**, * or ns."""
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def t_test(rows: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """log2 fold change of means + 1 and two-sided p of Student's t test, three against three; constant replicates give p 0."""
    mean = lambda c: sum((F.col(x) for x in c[1:]), F.col(c[0])) / len(c)
    square = lambda c, m: sum(((F.col(x) - m) * (F.col(x) - m) for x in c[1:]), (F.col(c[0]) - m) * (F.col(c[0]) - m))

    # Each step's numbers are bound once, as the variable of a one-element transform, so that no expression is written out again.
    bound = lambda value, then: F.transform(F.array(value), then)[0]
    spread = lambda m: F.sqrt((square(a, m["a"]) + square(b, m["b"])) / 4 * F.lit(2.0) / 3)
    slope = lambda t: t / F.sqrt(1 + t * t / 4)
    tail = lambda u: F.greatest(F.lit(0.0), 2 * (F.lit(0.5) - F.lit(0.375) * u * (1 - u * u / 12)))
    tested = lambda m: bound(spread(m), lambda s: F.when(s > 0, bound(F.abs(m["a"] - m["b"]) / s, lambda t: bound(slope(t), tail))).otherwise(0.0))
    result = bound(F.struct(mean(a).alias("a"), mean(b).alias("b")), lambda m: F.struct(F.log2((m["a"] + 1) / (m["b"] + 1)).alias("log2fc"), tested(m).alias("p")))
    return rows.withColumn("__t", result).withColumn("log2fc", F.col("__t.log2fc")).withColumn("p", F.col("__t.p")).drop("__t")


def false_discovery(rows: DataFrame, p: str, key: str) -> DataFrame:
    """Benjamini-Hochberg rates. Distinct p values are ranked, so ties share a rate; ranks come from counts by value.

    Rates of very frequent values are broadcast, at most HOT of them, so that a common p, such as 0, does not meet its rate in one task.
    """
    by_p = checkpointed(rows.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("n")))
    total = by_p.agg(F.sum("n").alias("__m"))
    ranked = counts_before(by_p, [], p).crossJoin(F.broadcast(total))  # one row
    ranked = ranked.withColumn("__rate", F.col(p) * F.col("__m") / (F.col("before") + F.col("n")))
    # The least rate of this value and all larger ones: within the part, then over the parts above, one row each.
    within = F.min("__rate").over(Window.partitionBy("part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    above = ranked.groupBy("part").agg(F.min("__rate").alias("__least")).withColumn("__above", F.min("__least").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))).drop("__least")
    rates = ranked.withColumn("__within", within).join(F.broadcast(above), "part")  # at most PARTS rows
    rates = rates.select(p, F.least(F.lit(1.0), F.col("__within"), F.coalesce("__above", F.lit(1.0))).alias("fdr"), (F.col("n") * HOT > F.col("__m")).alias("__hot"))
    common = F.broadcast(rates.where("__hot").select(F.col(p).alias("__p"), F.col("fdr").alias("__fdr")))
    rest = rates.where(~F.col("__hot")).select(p, "fdr")
    first = rows.join(common, F.col(p) == F.col("__p"), "left").drop("__p")
    found = first.where("__fdr is not null").withColumnRenamed("__fdr", "fdr")
    return found.unionByName(first.where("__fdr is null").drop("__fdr").join(rest, p).select(*found.columns))


def box(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 interquartile ranges) by group."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.75)).alias("q3"), F.count(value).alias("n"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    j = rows.join(q, by)
    ends = j.groupBy(*by).agg(F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("high"))
    return q.join(ends, by)


def log_gamma(x):
    """Natural logarithm of the gamma function of a positive column, to about 1e-15 of its value or of 1."""
    # Lanczos' coefficients for g = 7.
    terms = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
    y = x - 1.0
    total = F.lit(0.99999999999980993)
    for k, c in enumerate(terms, 1):
        total = total + F.lit(c) / (y + float(k))
    t = y + 7.5
    return F.lit(0.9189385332046727) + (y + 0.5) * F.log(t) - t + F.log(total)


def _beta_fraction(a, b, x, rounds):
    """The continued fraction of the incomplete beta function, worked forward by the modified method of Lentz."""
    tiny = F.lit(1e-300)
    apart = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = F.struct(F.lit(1.0).alias("c"), (1.0 / apart(1.0 - (a + b) * x / (a + 1.0))).alias("d"), (1.0 / apart(1.0 - (a + b) * x / (a + 1.0))).alias("h"))

    def half(s, by):
        d, c = 1.0 / apart(1.0 + by * s["d"]), apart(1.0 + by / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def even(s, m):
        return half(s, m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m)))

    def odd(s, m):
        return half(s, -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0)))

    # Each step is bound before the next reads it: numbers 2m and 2m + 1 of one sequence.
    step = lambda s, k: F.when(k % 2 == 0, even(s, F.floor(k / 2).cast("double"))).otherwise(odd(s, F.floor(k / 2).cast("double")))
    return F.aggregate(F.sequence(F.lit(2), rounds * 2 + 1), start, step)["h"]


def student_p(t, df):
    """Two-sided p of Student's t with any degrees of freedom above 0; null for null, 0 for an infinite t.

    It is the incomplete beta function of df / (df + t * t) with df / 2 and 1 / 2, by whichever of its two fractions converges."""
    t, df = t.cast("double"), df.cast("double")
    a, b = df / 2.0, F.lit(0.5)
    x, rest = df / (df + t * t), t * t / (df + t * t)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - F.lit(0.5723649429247001) + a * F.log(x) + b * F.log(rest))  # log of gamma of 1/2: a fixed value
    rounds = F.least(F.lit(64) + F.ceil(4 * F.sqrt(a)), F.lit(8192)).cast("int")
    near = x < (a + 1.0) / (a + b + 2.0)
    p = F.when(near, front * _beta_fraction(a, b, x, rounds) / a).otherwise(1.0 - front * _beta_fraction(b, a, rest, rounds) / b)
    sure = F.when(t.isNull() | df.isNull() | (df <= 0), None).when(rest == 0, 1.0).when(F.abs(t) == float("inf"), 0.0)
    return F.when(t.isNull() | df.isNull() | (df <= 0) | (rest == 0) | (F.abs(t) == float("inf")), sure).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def regression(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r, the slope's standard error and its two-sided p by group of three rows or more; p is 0 for a perfect line."""
    n = F.count(F.lit(1))
    g = rows.groupBy(*by).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    g = g.where((F.col("n") >= 3) & (F.col("vx") > 0))
    g = g.select(*by, "n", "slope", "intercept", "r", F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r") * F.col("r")) * F.col("vy") / F.col("vx") / (F.col("n") - 2))).alias("error"))
    g = g.withColumn("__t", F.when(F.col("error") > 0, F.col("slope") / F.col("error")).when(F.col("slope") == 0, 0.0).otherwise(float("inf"))).withColumn("__df", F.col("n") - 2)
    return g.withColumn("p", student_p(F.col("__t"), F.col("__df"))).drop("__t", "__df")


def density(rows: DataFrame, value: str, by: list[str], points: int = 128, reach: float = 3.0) -> DataFrame:
    """(by, nth, x, density): Gaussian kernel density by group at evenly spaced points from `reach` bandwidths below the least value to as many
    above the largest; the bandwidth is Scott's, the standard deviation times n to the power of -1/5.

    Values are counted at the nearest point first, so a group's kernels are sums over its points, however many its values. Groups of fewer than two
    distinct values have none; null values do not count.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("__n"), F.stddev_samp(value).alias("__sd"), F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high")).where("__sd > 0")
    g = g.withColumn("__h", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    g = g.withColumn("__from", F.col("__low") - reach * F.col("__h")).withColumn("__step", (F.col("__high") - F.col("__low") + 2 * reach * F.col("__h")) / (points - 1)).drop("__low", "__high", "__sd")
    same = [rows[c].eqNullSafe(g[c]) for c in by]
    at = F.floor((F.col(value) - F.col("__from")) / F.col("__step") + 0.5).cast("int")
    counted = (rows.join(g, same).drop(*[rows[c] for c in by]) if by else rows.crossJoin(F.broadcast(g))).where(F.col(value).isNotNull())  # one row
    own = [*by, "__n", "__h", "__from", "__step"]
    counted = counted.groupBy(*own, at.alias("__at")).agg(F.count(F.lit(1)).alias("__c"))
    held = counted.groupBy(*own).agg(F.collect_list(F.struct("__at", "__c")).alias("__held"))  # at most `points` a group
    grid = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("nth"))
    u = lambda s: (F.col("nth") - s["__at"]) * F.col("__step") / F.col("__h")
    total = F.aggregate("__held", F.lit(0.0), lambda acc, s: acc + s["__c"] * F.exp(-0.5 * u(s) * u(s)))
    return grid.select(*by, "nth", (F.col("__from") + F.col("nth") * F.col("__step")).alias("x"), (total / (F.col("__n") * F.col("__h") * F.lit(2.5066282746310002))).alias("density"))


def histogram(rows: DataFrame, value: str, width: int, by: list[str]) -> DataFrame:
    """Counts by bin and their share of the group."""
    h = rows.groupBy(*by, (F.floor(F.col(value) / width) * width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(*by)))


def expression_type(rows: DataFrame, p: float = 0.05, fdr: float = 0.05, fold: float = 1.0) -> DataFrame:
    """A>B or A<B of pairs that pass all three cuts."""
    sure = rows.where((F.col("p") < p) & (F.col("fdr") < fdr) & (F.abs(F.col("log2fc")) >= fold))
    return sure.withColumn("type", F.when(F.col("log2fc") > 0, "A>B").otherwise("A<B"))


def consistency(types: DataFrame, key: str, samples: int) -> DataFrame:
    """Consistent where a pair has one type in all samples, Inconsistent where it has several types."""
    n = types.groupBy(key).agg(F.countDistinct("type").alias("types"), F.countDistinct("sample").alias("samples"))
    return n.select(key, F.when(F.col("types") > 1, "Inconsistent").when(F.col("samples") == samples, "Consistent").alias("result")).where("result is not null")


def permutation(rows: DataFrame, group: str, size: int, times: int, seed: int = 5) -> DataFrame:
    """Counts by group of `size` rows drawn anew `times` times, (draw, group, n); the rows are few enough to be copied so often."""
    w = Window.partitionBy("draw").orderBy("__u", "__id")
    drawn = rows.withColumn("__id", F.xxhash64(*rows.columns)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("__u", F.xxhash64("__id", "draw", F.lit(seed)))
    return drawn.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).groupBy("draw", group).agg(F.count(F.lit(1)).alias("n"))
