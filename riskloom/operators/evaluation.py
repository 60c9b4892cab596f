"""Quality of scores against 0/1 labels, without sorting all scores in one task.

Every function takes rows with a ``score`` and a ``label`` column. Scores are first tallied per distinct value; running
sums over them go through range slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.insights import safe_div
from riskloom.operators.ordered import SLICE, running, slice_ordered

TARGET_FPR, TARGET_AUC = 0.012, 0.92
GRID_LOW, GRID_HIGH, GRID_POINTS = 0.001, 0.999, 1000


def tally(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def roc(scored: DataFrame) -> DataFrame:
    """A point per distinct score, from the highest down: point number (from 1), fpr, tpr, and the counts behind them."""
    counts = tally(scored).withColumn("_order", -F.col("score"))
    points = running(slice_ordered(counts, [], ["_order"]), [], ["_order"], {
        "tp": ("sum", F.col("positives")), "fp": ("sum", F.col("negatives")), "point": ("count", F.lit(1))}).drop(SLICE, "_order")
    totals = counts.agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n")).first()
    p, n = F.lit(float(totals.p or 0)), F.lit(float(totals.n or 0))  # their product outgrows a long
    return points.withColumns({"fpr": safe_div(F.col("fp"), n), "tpr": safe_div(F.col("tp"), p), "_p": p, "_n": n})


def roc_sample(points: DataFrame, about: int = 60) -> DataFrame:
    """About ``about`` evenly spaced points including both ends of the curve."""
    n = points.count() + 1
    step = max(1, n // about)
    start = points.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.union(points.where((F.col("point") % step == 0) | (F.col("point") == n - 1)).select("fpr", "tpr"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve by rank sums; equal scores count one half."""
    below = F.col("_n") - F.col("fp")
    wins = F.sum(F.col("positives") * (below + F.col("negatives") / 2))
    row = roc(scored).agg(wins.alias("wins"), F.max("_p").alias("p"), F.max("_n").alias("n"))
    return row.select((F.col("wins") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return {
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall,
        "f1": safe_div(2 * precision * recall, precision + recall), "fpr": safe_div(fp, fp + tn)}


def cells(threshold: Column | float) -> dict[str, Column]:
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    return {"tp": F.count_if(hit & positive), "fp": F.count_if(hit & ~positive), "tn": F.count_if(~hit & ~positive),
            "fn": F.count_if(~hit & positive)}


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    counted = scored.agg(*[c.alias(n) for n, c in cells(threshold).items()])
    return counted.select("*", *[F.round(r, 6).alias(n) for n, r in rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]).items()])


def sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts and rates for each threshold, in one pass."""
    per = [F.struct(F.lit(float(t)).alias("threshold"), *[c.alias(n) for n, c in cells(t).items()]) for t in thresholds]
    counted = scored.agg(F.array(*per).alias("all")).select(F.inline("all"))
    return counted.select("*", *[F.round(r, 6).alias(n) for n, r in rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]).items()])


def _grid_point(index: Column) -> Column:
    return F.lit(GRID_LOW) + index * ((GRID_HIGH - GRID_LOW) / (GRID_POINTS - 1))


def grid_threshold(scored: DataFrame, target_fpr: float = TARGET_FPR) -> DataFrame:
    """The first of 1,000 ascending thresholds whose FPR is within the target; 0.5 and FPR 1 if none is.

    Scores fall into grid cells, so the window below runs over at most 1,001 rows.
    """
    guess = F.floor((F.col("score") - GRID_LOW) / ((GRID_HIGH - GRID_LOW) / (GRID_POINTS - 1)))
    exact = F.when(_grid_point(guess) > F.col("score"), guess - 1).when(_grid_point(guess + 1) <= F.col("score"), guess + 1).otherwise(guess)
    cell = F.least(F.greatest(exact, F.lit(-1)), F.lit(GRID_POINTS - 1)).alias("cell")  # highest grid point <= score
    negatives = scored.where(F.col("label") == 0).groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(-1, GRID_POINTS).select(F.col("id").alias("cell"))
    above = Window.partitionBy().orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    table = grid.join(negatives, "cell", "left").withColumn("fp", F.sum(F.coalesce("n", F.lit(0))).over(above))
    total = F.max("fp").over(Window.partitionBy())
    fitting = table.withColumn("fpr", safe_div(F.col("fp"), total)).where((F.col("cell") >= 0) & (F.col("fpr") <= target_fpr))
    best = fitting.agg(F.min_by(F.struct("cell", "fpr"), "cell").alias("b"))
    return best.select(F.coalesce(_grid_point(F.col("b.cell")), F.lit(0.5)).alias("threshold"), F.coalesce("b.fpr", F.lit(1.0)).alias("fpr"))


def roc_threshold(scored: DataFrame, mode: str = "roc", target_fpr: float = TARGET_FPR) -> DataFrame:
    """``roc``: the last point along the curve within the target FPR. ``youden``: the point with the largest tpr - fpr."""
    points = roc(scored)
    if mode == "roc":
        best = points.where(F.col("fpr") <= target_fpr).agg(F.min_by(F.struct("score", "fpr"), "score").alias("b"))
    elif mode == "youden":
        best = points.agg(F.max_by(F.struct("score", "fpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), "score")).alias("b"))
    else:
        raise ValueError(mode)
    clipped = F.least(F.greatest(F.col("b.score"), F.lit(0.0)), F.lit(1.0))
    return best.select(F.coalesce(clipped, F.lit(1.0)).alias("threshold"), F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"))


def acceptance(auc_value: Column, fpr: Column, min_auc: float = TARGET_AUC, max_fpr: float = TARGET_FPR) -> Column:
    return (auc_value >= min_auc) & (fpr <= max_fpr)


def agreement(rows: DataFrame, champion: Column, challenger: Column) -> DataFrame:
    """How often two fraud verdicts agree."""
    counted = rows.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(champion == challenger).alias("agree"),
        F.count_if(champion != challenger).alias("disagree"), F.count_if(challenger).alias("challenger_fraud"),
        F.count_if(champion).alias("live_fraud"))
    share = lambda c: F.round(F.col(c) / F.nullif(F.col("samples"), F.lit(0)), 4)
    return counted.withColumns({
        "agreement_rate": share("agree"), "disagreement_rate": share("disagree"),
        "challenger_fraud_rate": share("challenger_fraud"), "live_fraud_rate": share("live_fraud")})


METRICS = {"auc": 1, "accuracy": 1, "precision": 1, "recall": 1, "f1": 1, "fpr": -1}


def compare_runs(runs: DataFrame) -> DataFrame:
    """(run_id, metric, value, best): the best run per metric; a lower FPR is better."""
    long = runs.select("run_id", *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(["run_id"], list(METRICS), "metric", "value")
    signed = F.when(F.col("metric") == "fpr", -F.col("value")).otherwise(F.col("value"))
    top = long.groupBy("metric").agg(F.max(signed).alias("_top"))
    return long.join(F.broadcast(top), "metric").select("run_id", "metric", "value", (signed == F.col("_top")).alias("best"))
