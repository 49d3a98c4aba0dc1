"""Evaluation: curves, thresholds, agreement, estimators of distributions, learned maps."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def accuracy_reject_curve(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """``threshold, n_retained, n_correct, coverage, accuracy`` for each distinct confidence.

    Rows are summed by confidence first. Running sums are made within range partitions and shifted by the sums of
    the partitions before, so no task sees all thresholds.
    """
    each = df.groupBy(F.col(confidence).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("c"))
    parted = each.repartitionByRange(F.desc("threshold")).withColumn("part", F.spark_partition_id()).persist()
    sums = parted.groupBy("part").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    down = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = parted.select("part", "threshold", F.sum("n").over(down).alias("n"), F.sum("c").over(down).alias("c")).join(F.broadcast(shift), "part")
    total = sums.agg(F.sum("n").alias("total"))
    kept = run.select("threshold", (F.col("n") + F.col("n0")).alias("n_retained"), (F.col("c") + F.col("c0")).alias("n_correct"))
    return kept.join(F.broadcast(total)).select("threshold", "n_retained", "n_correct", (F.col("n_retained") / F.col("total")).alias("coverage"), (F.col("n_correct") / F.col("n_retained")).alias("accuracy"))


def pick_threshold(curve: DataFrame, target: float, min_coverage: float) -> DataFrame:
    """The curve's row at the lowest threshold that is accurate and covers enough; no row if none does."""
    ok = curve.where((F.col("accuracy") >= target) & (F.col("coverage") >= min_coverage))
    return ok.orderBy("threshold").limit(1)


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high), within 0 and 1; null without cases."""
    p = k / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (centre - half) / scale).alias("low"), F.least(F.lit(1.0), (centre + half) / scale).alias("high")))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, npv, agreement, kappa."""
    c = df.agg(
        F.count_if(predicted & actual).cast("double").alias("tp"), F.count_if(predicted & ~actual).cast("double").alias("fp"), F.count_if(~predicted & actual).cast("double").alias("fn"), F.count_if(~predicted & ~actual).cast("double").alias("tn")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    observed = (tp + tn) / n
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return c.select(*[x.cast("bigint").alias(a) for x, a in zip((tp, fp, fn, tn), ("tp", "fp", "fn", "tn"))], F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tn, tn + fn).alias("npv"), observed.alias("agreement"), F.try_divide(observed - expected, 1 - expected).alias("kappa"))


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Agreement and Cohen's kappa of two codings, for each group."""
    by = by or []
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sums = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*by, F.col("x").alias("v")).agg(F.sum("n").alias("nx"))
    cols = cells.groupBy(*by, F.col("y").alias("v")).agg(F.sum("n").alias("ny"))
    chance = rows.join(cols, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("e"))
    both = sums.join(chance, by, "left") if by else sums.join(F.broadcast(chance))
    observed = F.col("same") / F.col("total")
    expected = F.coalesce("e", F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    return both.select(*by, F.col("total").alias("n"), observed.alias("agreement"), F.try_divide(observed - expected, 1 - expected).alias("kappa"))


def krippendorff_alpha(codes: DataFrame, item: str, code: str) -> DataFrame:
    """One row ``n_items, n_codes, alpha`` for nominal codes in rows ``item, code``; items with one code don't count.

    Items are counted by code first; a pair of codes weighs 1/(codes of the item - 1).
    """
    each = codes.where(F.col(code).isNotNull()).groupBy(item, code).agg(F.count(F.lit(1)).alias("n"))
    sized = each.join(each.groupBy(item).agg(F.sum("n").alias("m")), item).where("m >= 2")
    totals = sized.groupBy(code).agg(F.sum("n").cast("double").alias("t"))
    same = sized.agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("same"), F.sum("n").cast("double").alias("n_codes"), F.count_distinct(item).alias("n_items"))
    squares = totals.agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("sq"))
    observed = 1 - F.col("same") / F.col("n_codes")
    expected = 1 - F.col("sq") / (F.col("n_codes") * (F.col("n_codes") - 1))
    return same.join(F.broadcast(squares)).select("n_items", F.col("n_codes").cast("bigint").alias("n_codes"), (1 - F.try_divide(observed, expected)).alias("alpha"))


def class_scores(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted F1 over the classes that occur on either side."""
    by = by or []
    cells = df.groupBy(*by, F.col(actual).alias("x"), F.col(predicted).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("is_x")), F.struct(F.col("y").alias("v"), F.lit(0).alias("is_x")))).alias("s"), (F.col("x") == F.col("y")).alias("hit"), "n")
    per = sides.groupBy(*by, F.col("s.v").alias("v")).agg(
        F.sum(F.when(F.col("s.is_x") == 1, F.col("n")).otherwise(0)).alias("nx"), F.sum(F.when(F.col("s.is_x") == 0, F.col("n")).otherwise(0)).alias("ny"), F.sum(F.when(F.col("hit") & (F.col("s.is_x") == 1), F.col("n")).otherwise(0)).alias("tp")
    )
    f1 = 2 * F.col("tp") / (F.col("nx") + F.col("ny"))
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("nx")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("nx")) / F.sum("nx")).alias("weighted_f1"))


def distribution_error(df: DataFrame, label: str, estimate: str, truth: str) -> DataFrame:
    """Total variation distance and mean absolute error (in points) of two shares in rows ``label, estimate, truth``."""
    gap = F.abs(F.col(estimate) - F.col(truth))
    return df.agg((F.sum(gap) / 2).alias("tvd"), (F.avg(gap) * 100).alias("mae_points"), F.max_by(label, gap).alias("worst"))


def soft_shares(df: DataFrame, label: str, p: str) -> DataFrame:
    """Probabilities summed by label, adding up to one."""
    sums = df.groupBy(label).agg(F.sum(p).alias("s"))
    total = df.agg(F.sum(p).alias("t"))
    return sums.join(F.broadcast(total)).select(label, (F.col("s") / F.col("t")).alias("share"))


def multilabel_scores(df: DataFrame, predicted: str, primary: str, distribution: str, secondary: str) -> DataFrame:
    """Shares of rows whose prediction is the primary field, that or a declared secondary one, any tagged one; the mean
    weight of the predicted field and its ceiling; and the share of rows with several fields."""
    p = F.col(predicted)
    weights = F.transform(distribution, lambda x: x["p"])
    credit = F.coalesce(F.get(F.filter(distribution, lambda x: x["field"] == p), 0)["p"], F.lit(0.0))
    strict = p == F.col(primary)
    return df.agg(
        F.avg(strict.cast("double")).alias("strict"),
        F.avg((strict | F.array_contains(secondary, p)).cast("double")).alias("secondary"),
        F.avg(F.exists(distribution, lambda x: x["field"] == p).cast("double")).alias("any_tagged"),
        F.avg(credit).alias("partial"),
        F.avg(F.array_max(weights)).alias("achievable"),
        F.avg((F.size(distribution) > 1).cast("double")).alias("multi_field"),
    )


def learned_map(pairs: DataFrame, label: str, field: str, least: int = 5, share: float = 0.5) -> DataFrame:
    """``label, field, n, share``: the commonest field of a label, ties to the first by name, where a label has
    enough cases and the field enough of them."""
    counts = pairs.where(F.col(label).isNotNull() & F.col(field).isNotNull()).groupBy(label, field).agg(F.count(F.lit(1)).alias("k"))
    best = counts.groupBy(label).agg(F.min_by(field, F.struct(-F.col("k"), F.col(field))).alias("field"), F.sum("k").alias("n"), F.max("k").alias("k"))
    return best.select(label, "field", "n", (F.col("k") / F.col("n")).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))


def conditional_shares(pairs: DataFrame, label: str, field: str) -> DataFrame:
    """``label, field, p``."""
    counts = pairs.groupBy(label, field).agg(F.count(F.lit(1)).alias("k"))
    return counts.select(label, field, (F.col("k") / F.sum("k").over(Window.partitionBy(label))).alias("p"))


def modal_vote(df: DataFrame, key: str, field: str) -> DataFrame:
    """The commonest field of each key, ties to the first by name."""
    return df.where(F.col(field).isNotNull()).groupBy(key, field).agg(F.count(F.lit(1)).alias("k")).groupBy(key).agg(F.min_by(field, F.struct(-F.col("k"), F.col(field))).alias(field))


def summary(df: DataFrame, by: str, *metrics: str) -> DataFrame:
    """Mean and sample deviation to three decimals, half to even."""
    return df.groupBy(by).agg(*[F.bround(F.avg(m), 3).alias(f"{m}_mean") for m in metrics], *[F.bround(F.stddev_samp(m), 3).alias(f"{m}_std") for m in metrics])


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of labels that differ, with their counts."""
    return df.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def learning_curve_fit(df: DataFrame, size: str, metric: str) -> DataFrame:
    """Slope for each doubling of the size, intercept and R2 of a fit on its binary logarithm."""
    x = F.log2(size)
    return df.agg(F.regr_slope(F.col(metric), x).alias("slope_per_doubling"), F.regr_intercept(F.col(metric), x).alias("intercept"), F.regr_r2(F.col(metric), x).alias("r2"))


def wilcoxon(df: DataFrame, a: str, b: str) -> dict:
    """Signed-rank test of paired values (a few splits): statistic, n, and a p-value, exact to 25 pairs without ties."""
    gaps = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = gaps.withColumn("r", F.avg(F.row_number().over(Window.orderBy("m"))).over(Window.partitionBy("m")))
    r = ranked.agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)).alias("plus"), F.sum("r").alias("all"), F.count(F.lit(1)).alias("n"), F.count_distinct("m").alias("k")).first()
    n = r["n"]
    if not n:
        return {"statistic": 0.0, "n": 0, "p": 1.0}
    w = min(r["plus"], r["all"] - r["plus"])
    if n <= 25 and r["k"] == n:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for i in range(1, n + 1):
            for s in range(len(ways) - 1, i - 1, -1):
                ways[s] += ways[s - i]
        p = min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    else:
        from math import erfc

        mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
        p = erfc(abs(w - mean) / sqrt(2 * var))
    return {"statistic": float(w), "n": n, "p": p}
