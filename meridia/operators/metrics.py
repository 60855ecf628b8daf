"""Ranking and probability metrics, exact, by ranks and running sums over distinct scores.

Scores are first grouped to one row for each distinct score. What a window then orders is the
number of distinct scores of a group, and equal scores never split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import scalars as fx

ALERT_RATES = (0.01, 0.05, 0.1)


def running(counts: DataFrame, order: str, value: str, by: Sequence[str] = (), descending: bool = False, parts: int = 64) -> DataFrame:
    """counts with upto: the running sum of value in the order, the row included.

    Within groups a window does. Without groups rows are dealt into ranges of the order, each summed by
    itself, and the sums of earlier ranges, a row for each range, are added: no task sees all rows.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc(order) if descending else F.asc(order))
        return counts.withColumn("upto", F.sum(value).over(w))
    edges = counts.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("_edges"))
    dealt = counts.join(F.broadcast(edges)).withColumn("_part", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(order)))).drop("_edges")
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    at = Window.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    # At most parts rows.
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(at), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(F.desc(order) if descending else F.asc(order))
    rows = dealt.join(F.broadcast(before), "_part")
    return rows.withColumn("upto", F.col("_before") + F.sum(value).over(w)).drop("_part", "_before")


def quantiles(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row, e: the interpolated quantiles of a column, from running counts of its distinct values."""
    s = running(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k")), "v", "k")
    s = s.join(F.broadcast(s.agg(F.sum("k").alias("n"))))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("k") <= place), F.col("v")))

    found = []
    for q in shares:
        place = F.lit(float(q)) * (F.col("n") - 1)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        found.append(low + (high - low) * part)
    return s.agg(F.array(*found).alias("e"))


def _scores(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.where("score is not null and label is not null").groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def roc_auc(rows: DataFrame, by: Sequence[str] = (), min_events: int = 0) -> DataFrame:
    """n, n_events and auc, ties at half; null with one class only or fewer events than min_events."""
    s = _scores(rows, by).withColumn("neg", F.col("n") - F.col("pos"))
    s = running(s, "score", "neg", by).withColumn("lower", F.col("upto") - F.col("neg"))
    out = (s.groupBy(*by) if by else s.groupBy()).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_events"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2.0)).alias("wins"))
    auc = F.when((F.col("n_events") > 0) & (F.col("n_neg") > 0) & (F.col("n_events") >= min_events), F.col("wins") / (F.col("n_events").cast("double") * F.col("n_neg")))
    return out.select(*by, "n", "n_events", auc.alias("auc"))


def average_precision(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores, from the top, of precision times the recall gained."""
    s = running(_scores(rows, by), "score", "pos", by, descending=True).withColumnRenamed("upto", "tp")
    s = running(s, "score", "n", by, descending=True).withColumnRenamed("upto", "seen")
    out = (s.groupBy(*by) if by else s.groupBy()).agg(F.sum(F.col("tp") / F.col("seen") * F.col("pos")).alias("w"), F.sum("pos").alias("p"))
    return out.select(*by, F.try_divide(F.col("w"), F.col("p")).alias("average_precision"))


def brier_log_loss(rows: DataFrame, by: Sequence[str] = (), clip: float = 1e-15) -> DataFrame:
    """Brier score and log loss; null unless all scores are probabilities."""
    p = F.least(F.greatest(F.col("score"), F.lit(clip)), F.lit(1 - clip))
    y = F.col("label").cast("double")
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.avg(F.pow(F.col("score") - y, 2)).alias("b"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("l"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    ok = (F.col("lo") >= 0) & (F.col("hi") <= 1)
    return out.select(*by, F.when(ok, F.col("b")).alias("brier"), F.when(ok, F.col("l")).alias("log_loss"))


def alert_k(n: Column, rate: float) -> Column:
    """max(1, rate * n rounded half to even)."""
    return F.greatest(F.lit(1), F.bround(F.lit(rate) * n).cast("long"))


def alerts(rows: DataFrame, row_id: str = "row_id", rates: Sequence[float] = ALERT_RATES, by: Sequence[str] = ()) -> DataFrame:
    """rate, k, true_positives, precision and recall of the top share; ties by row id.

    The k-th row is found from counts of distinct scores; only rows that tie with it are ranked
    one by one.
    """
    s = _scores(rows, by)
    whole = (s.groupBy(*by) if by else s.groupBy()).agg(F.sum("n").alias("total"), F.sum("pos").alias("events"))
    s = running(s, "score", "pos", by, descending=True).withColumnRenamed("upto", "tp_upto")
    s = running(s, "score", "n", by, descending=True)
    s = s.join(whole, list(by)) if by else s.join(F.broadcast(whole))
    parts = []
    for rate in rates:
        k = alert_k(F.col("total"), rate)
        edge = s.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select(*by, "score", F.lit(rate).alias("rate"), k.alias("k"), (k - (F.col("upto") - F.col("n"))).alias("take"), (F.col("tp_upto") - F.col("pos")).alias("tp_above"), "events")
        parts.append(edge)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    tied = rows.where("label is not null").join(edges, [*by, "score"])
    order = F.row_number().over(Window.partitionBy(*by, "rate").orderBy(row_id))
    top = tied.withColumn("place", order).groupBy(*by, "rate", "k", "tp_above", "events").agg(F.sum(F.when(F.col("place") <= F.col("take"), F.col("label").cast("long")).otherwise(0)).alias("tp_tied"))
    tp = F.col("tp_above") + F.col("tp_tied")
    return top.select(*by, "rate", "k", tp.alias("true_positives"), (tp / F.col("k")).alias("precision"), F.try_divide(tp.cast("double"), F.col("events")).alias("recall"))


def pct_rank(rows: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Average rank over the group's size, times 100: what percent rank with averaged ties gives."""
    s = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by)
    s = s.withColumn("upto", F.sum("k").over(w.orderBy(score))).withColumn("total", F.sum("k").over(w))
    s = s.select(*by, score, (100.0 * (F.col("upto") - (F.col("k") - 1) / 2.0) / F.col("total")).alias("pct_rank"))
    return rows.join(s, [*by, score])


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Quantile bins [lo, hi) with equal edges collapsed: mean score, event rate and count."""
    qs = [i / bins for i in range(bins + 1)]
    edges = quantiles(rows, "score", qs).select(F.array_distinct("e").alias("e"))
    # One row with at most bins + 1 numbers.
    joined = rows.join(F.broadcast(edges))
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda x: x <= F.col("score"))).cast("long")
    return joined.groupBy(at.alias("bin")).agg(F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("event_rate"), F.count(F.lit(1)).alias("n"))


def lift(rows: DataFrame, flags: Sequence[str], label: str = "label") -> DataFrame:
    """flag, event and comparison rates and their quotient; flags are unpivoted once."""
    long = rows.unpivot([label], list(flags), "flag", "on").groupBy("flag").agg(F.avg(F.when(F.col(label) == 1, F.col("on").cast("double"))).alias("event_rate"), F.avg(F.when(F.col(label) == 0, F.col("on").cast("double"))).alias("comparison_rate"))
    return long.withColumn("lift", F.try_divide(F.col("event_rate"), F.col("comparison_rate")))


def confusion(rows: DataFrame, a: str, b: str, dimension: str | None = None) -> DataFrame:
    """Pair counts, for each dimension and in total by one rollup."""
    if dimension is None:
        return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sets = rows.groupingSets([[F.col(dimension), F.col(a), F.col(b)], [F.col(a), F.col(b)]], dimension, a, b)
    return sets.agg(F.count(F.lit(1)).alias("n"))


def matched_budget(rows: DataFrame, flag: str, row_id: str = "row_id") -> DataFrame:
    """Events caught by a flag, and by as many rows of highest score.

    The last score within the budget is found from counts of distinct scores; only its ties are ranked.
    """
    n = rows.agg(F.count_if(F.col(flag)).alias("budget"), F.sum(F.when(F.col(flag), F.col("label").cast("long")).otherwise(0)).alias("flag_events"))
    s = rows.groupBy("score").agg(F.count(F.lit(1)).alias("k"))
    s = running(s, "score", "k", descending=True).join(F.broadcast(n))
    edge = s.where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("k") < F.col("budget"))).select(F.col("score").alias("_edge"), (F.col("budget") - (F.col("upto") - F.col("k"))).alias("_take"))
    # Single rows.
    both = rows.select("label", "score", F.col(row_id).alias("_id"), F.col(flag).alias("_f")).join(F.broadcast(n)).join(F.broadcast(edge), how="left")
    tied = both.where(F.col("score") == F.col("_edge")).withColumn("_in", F.row_number().over(Window.partitionBy("score").orderBy("_id")) <= F.col("_take"))
    rest = both.where(~F.coalesce(F.col("score") == F.col("_edge"), F.lit(False))).withColumn("_in", F.coalesce(F.col("score") > F.col("_edge"), F.lit(False)))
    out = tied.unionByName(rest).groupBy("budget", "flag_events").agg(F.sum(F.when(F.col("_in"), F.col("label").cast("long")).otherwise(0)).alias("score_events"), F.count_if(F.col("_in") & F.col("_f")).alias("overlap"))
    return out.withColumn("overlap_share", F.try_divide(F.col("overlap").cast("double"), F.col("budget")))


def wilson_rows(rows: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = fx.wilson("k", "n")
    return out.select(*by, "k", "n", low.alias("low"), high.alias("high"))
