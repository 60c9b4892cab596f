"""Preparation, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.catalog.sqlparts import ALERTS, FEATURES as FEATURE_SQL, LATEST_FEEDBACK, PLAIN_ALERTS, TX
from riskloom.contracts import FEATURES
from riskloom.operators import attribution, cases, decisions, evaluation, features, learners, ranking, star
from riskloom.session import materialise
from riskloom.sources import files, tables

SCORED = f"""{PLAIN_ALERTS}, sc AS (SELECT id, risk_score AS score, CASE WHEN amount > 60 OR risk_score > 0.9 THEN 1 ELSE 0 END AS label FROM pa),
tl AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY score),
roc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, row_number() OVER (ORDER BY score DESC) AS point,
sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM tl)"""


def _scored(spark, folder):
    """Fixed scores with labels that lean on them."""
    rows = tables.plain_alerts(spark, folder)
    return rows.select("id", F.col("risk_score").alias("score"), ((F.col("amount") > 60) | (F.col("risk_score") > 0.9)).cast("int").alias("label"))


CELLS = """count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp,
count(*) FILTER (WHERE score < {t} AND label = 0) AS tn, count(*) FILTER (WHERE score < {t} AND label = 1) AS fn"""
RATES = """round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
round(tp::DOUBLE / (tp + fn), 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1, round(fp::DOUBLE / (fp + tn), 6) AS fpr"""


@query("agg21_confusion", f"WITH {SCORED}, c AS (SELECT {CELLS.format(t=0.8)} FROM sc) SELECT *, {RATES} FROM c")
def agg21(spark, folder):
    return evaluation.confusion(_scored(spark, folder), 0.8)


@query("ml7_auc", f"WITH {SCORED} SELECT round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / max(p) / max(n), 9) AS auc FROM roc")
def ml7(spark, folder):
    return evaluation.auc(_scored(spark, folder)).select(F.round("auc", 9).alias("auc"))


@query("ml8_roc_curve", f"WITH {SCORED} SELECT score, point, round(fp::DOUBLE / n, 9) AS fpr, round(tp::DOUBLE / p, 9) AS tpr FROM roc")
def ml8(spark, folder):
    points = evaluation.roc(_scored(spark, folder))
    return points.select("score", "point", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("ml8_roc_sample", f"""WITH {SCORED}, k AS (SELECT greatest(1, (count(*) + 1) // 60) AS step, count(*) AS last FROM roc)
SELECT round(fp::DOUBLE / n, 9) AS fpr, round(tp::DOUBLE / p, 9) AS tpr FROM roc, k WHERE point % step = 0 OR point = last UNION ALL SELECT 0.0, 0.0""")
def ml8_sample(spark, folder):
    sample = evaluation.roc_sample(materialise(evaluation.roc(_scored(spark, folder))))
    return sample.select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("ml9_threshold_grid", f"""WITH {SCORED}, g AS (SELECT i, 0.001::DOUBLE + i * ((0.999::DOUBLE - 0.001::DOUBLE) / 999) AS th FROM range(1000) r(i)),
f AS (SELECT i, th, (SELECT count(*) FROM sc WHERE label = 0 AND score >= th)::DOUBLE / (SELECT count(*) FROM sc WHERE label = 0) AS fpr FROM g)
SELECT round(th, 9) AS threshold, round(fpr, 9) AS fpr FROM f WHERE fpr <= 0.012 ORDER BY i LIMIT 1""")
def ml9_grid(spark, folder):
    best = evaluation.grid_threshold(_scored(spark, folder))
    return best.select(F.round("threshold", 9).alias("threshold"), F.round("fpr", 9).alias("fpr"))


@query("ml9_threshold_roc", f"""WITH {SCORED} SELECT coalesce(min(score), 1.0) AS threshold, round(coalesce(max(fp::DOUBLE / n), 0), 9) AS fpr
FROM roc WHERE fp::DOUBLE / n <= 0.012""")
def ml9_roc(spark, folder):
    best = evaluation.roc_threshold(_scored(spark, folder))
    return best.select("threshold", F.round("fpr", 9).alias("fpr"))


@query("ml9_threshold_youden", f"""WITH {SCORED} SELECT score AS threshold, round(fp::DOUBLE / n, 9) AS fpr FROM roc
ORDER BY round(tp::DOUBLE / p - fp::DOUBLE / n, 12) DESC, score DESC LIMIT 1""")
def ml9_youden(spark, folder):
    best = evaluation.roc_threshold(_scored(spark, folder), "youden")
    return best.select("threshold", F.round("fpr", 9).alias("fpr"))


STEPS = [round(0.05 * i, 2) for i in range(1, 20)]


@query("ml10_threshold_sweep", f"WITH {SCORED}, c AS (" + " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, {CELLS.format(t=t)} FROM sc" for t in STEPS) + f") SELECT *, {RATES} FROM c")
def ml10(spark, folder):
    return evaluation.sweep(_scored(spark, folder), STEPS)


SECOND = "((id * 6151 % 1000) / 1000.0)"


def _second_score():
    return F.col("id") * 6151 % 1000 / 1000


AGREE_SQL = """count(*) AS samples, count(*) FILTER (WHERE live = chal) AS agree, count(*) FILTER (WHERE live <> chal) AS disagree,
count(*) FILTER (WHERE chal) AS challenger_fraud, count(*) FILTER (WHERE live) AS live_fraud"""
AGREE_RATES = """round(agree::DOUBLE / samples, 4) AS agreement_rate, round(disagree::DOUBLE / samples, 4) AS disagreement_rate,
round(challenger_fraud::DOUBLE / samples, 4) AS challenger_fraud_rate, round(live_fraud::DOUBLE / samples, 4) AS live_fraud_rate"""


@query("agg22_shadow_agreement", f"""WITH {PLAIN_ALERTS}, v AS (SELECT risk_label = 'FRAUD' AS live, {SECOND} >= 0.5 AS chal FROM pa),
c AS (SELECT {AGREE_SQL} FROM v) SELECT *, {AGREE_RATES} FROM c""")
def agg22(spark, folder):
    rows = tables.plain_alerts(spark, folder)
    return evaluation.agreement(rows, F.col("risk_label") == "FRAUD", _second_score() >= 0.5)


@query("ml14_champion_challenger", f"""WITH {SCORED}, m AS (SELECT id, label, score AS champion, {SECOND} AS challenger FROM sc)
SELECT id, round(challenger, 4) AS challenger_score, challenger >= 0.5 AS challenger_fraud, champion >= 0.2078 AS live_fraud,
(challenger >= 0.5) = (champion >= 0.2078) AS agree FROM m""")
def ml14(spark, folder):
    chal, live = _second_score() >= 0.5, F.col("score") >= 0.2078
    return _scored(spark, folder).select("id", F.round(_second_score(), 4).alias("challenger_score"), chal.alias("challenger_fraud"),
                                         live.alias("live_fraud"), (chal == live).alias("agree"))


RUN_SCORES = {"fixed": "score", "second": SECOND, "blend": f"(score + {SECOND}) / 2"}
RUN_SQL = " UNION ALL ".join(f"""SELECT '{name}' AS run_id, {RATES.replace('6)', '6)')}, (SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6)
FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM (SELECT {expr} AS s, count(*) FILTER (WHERE label = 1) AS pos,
count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY 1))) AS auc FROM (SELECT {CELLS.format(t=0.5)} FROM (SELECT {expr} AS score, label FROM sc))"""
                              for name, expr in RUN_SCORES.items())


def _run_metrics(spark, folder):
    scored = _scored(spark, folder)
    columns = {"fixed": F.col("score"), "second": _second_score(), "blend": (F.col("score") + _second_score()) / 2}
    out = None
    for name, column in columns.items():
        rows = scored.withColumn("score", column)
        auc = evaluation.auc(rows).first().auc
        run = evaluation.confusion(rows, 0.5).withColumns({"run_id": F.lit(name), "auc": F.lit(round(auc, 6))})
        out = run if out is None else out.unionByName(run)
    return out


@query("ml15_run_comparison", f"""WITH {SCORED}, r AS ({RUN_SQL}), l AS (UNPIVOT r ON auc, accuracy, precision, recall, f1, fpr INTO NAME metric VALUE value)
SELECT run_id, metric, value, CASE WHEN metric = 'fpr' THEN value = min(value) OVER (PARTITION BY metric)
ELSE value = max(value) OVER (PARTITION BY metric) END AS best FROM l""")
def ml15(spark, folder):
    return evaluation.compare_runs(_run_metrics(spark, folder))


@query("ml17_acceptance_gate", f"""WITH {SCORED}, r AS ({RUN_SQL}) SELECT run_id, auc >= 0.92 AND fpr <= 0.012 AS accepted FROM r""")
def ml17(spark, folder):
    return _run_metrics(spark, folder).select("run_id", evaluation.acceptance(F.col("auc"), F.col("fpr")).alias("accepted"))


@query("ml18_retraining_set", f"""WITH {ALERTS}, {LATEST_FEEDBACK} SELECT id, tx_count_5m, tx_count_1h, tx_count_24h, round(sum_amount_1h, 4) AS sum_amount_1h,
device_shift, CASE label WHEN 'confirmed_fraud' THEN 1 ELSE 0 END AS is_fraud FROM al JOIN lf ON alert_id = id""")
def ml18(spark, folder):
    latest = cases.latest_feedback(tables.feedback(spark, folder))
    out = learners.retraining_set(tables.alerts(spark, folder), latest)
    return out.withColumn("sum_amount_1h", F.round("sum_amount_1h", 4))


@query("ml1_preprocess", f"""WITH {FEATURE_SQL}, e AS (SELECT *, dense_rank() OVER (ORDER BY device_id) - 1 AS device_code FROM
(SELECT *, CASE WHEN amount < 1 THEN -999.0 ELSE amount END AS filled FROM ft))
SELECT transaction_id, device_code, filled AS amount, round(avg_amount_1h, 6) AS avg_amount_1h, CASE WHEN row_number() OVER (ORDER BY t, transaction_id)
<= (SELECT count(*) * 8 // 10 FROM ft) THEN 'train' ELSE 'validation' END AS part FROM e""")
def ml1(spark, folder):
    rows = features.behaviour(tables.transactions(spark, folder)).withColumn("amount", F.when(F.col("amount") >= 1, F.col("amount")))
    out = learners.prepare(rows, ["device_id"], ["amount", "avg_amount_1h"], ["event_time_seconds", "transaction_id"])
    return out.select("transaction_id", F.col("device_id").alias("device_code"), "amount", F.round("avg_amount_1h", 6).alias("avg_amount_1h"), "part")


@query("prj14_aligned_features", f"""WITH {TX} SELECT transaction_id, CASE WHEN amount < 1 THEN -999.0 ELSE amount END AS amount, -999.0::DOUBLE AS card2,
device_id, 'unknown' AS "ProductCD", dense_rank() OVER (ORDER BY device_id) - 1 AS device_code FROM tx""")
def prj14(spark, folder):
    rows = tables.transactions(spark, folder).select(
        "transaction_id", F.when(F.col("amount") >= 1, F.col("amount")).alias("amount"), "device_id")
    out = learners.align(rows, ["amount", "card2"], ["device_id", "ProductCD"]).withColumn("device_code", F.col("device_id"))
    return learners.encode(out, learners.label_codes(rows, "device_id"), "device_code")


@query("ml6_stratified_split", f"""WITH {TX}, r AS (SELECT transaction_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(transaction_id::VARCHAR), transaction_id) AS rn,
count(*) OVER (PARTITION BY is_fraud) AS n FROM tx) SELECT transaction_id, CASE WHEN rn <= floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM r""")
def ml6(spark, folder):
    return ranking.stratified_split(tables.transactions(spark, folder), "is_fraud", "transaction_id", 0.2).select("transaction_id", "part")


@query("ml12_heuristic_attribution", f"""WITH {FEATURE_SQL} SELECT transaction_id, round(tx_count_5m * 0.05::DOUBLE, 4) AS c5m, round(tx_count_24h * -0.002::DOUBLE, 4) AS c24h,
CASE WHEN device_shift = 1 THEN 0.35::DOUBLE ELSE -0.05::DOUBLE END AS shift FROM ft""")
def ml12(spark, folder):
    rows = features.behaviour(tables.transactions(spark, folder)).withColumn("a", attribution.heuristic())
    return rows.select("transaction_id", F.col("a")["tx_count_5m"].alias("c5m"), F.col("a")["tx_count_24h"].alias("c24h"),
                       F.col("a")["device_shift"].alias("shift"))


# ---------------------------------------------------------------- fitted models: checked by invariants in the tests

def _split(spark, folder):
    fact = star.fact(features.behaviour(tables.transactions(spark, folder)))
    return materialise(ranking.stratified_split(fact, "isFraud", "transaction_id"))


def _metrics(scored, threshold=None):
    scored = scored.withColumn("label", F.col("isFraud"))
    cut = threshold if threshold is not None else evaluation.roc_threshold(scored).first().threshold
    out = evaluation.confusion(scored, cut)
    return out.withColumns({"threshold": F.lit(cut), "auc": F.lit(evaluation.auc(scored).first().auc)})


def _evaluated(spark, folder, algorithm, **hp):
    rows = _split(spark, folder)
    model = learners.fit(algorithm, rows.where("part = 'train'"), **hp)
    return _metrics(learners.score(model, rows.where("part = 'validation'")))


@query("ml2_boosted_trees")
def ml2(spark, folder):
    return _evaluated(spark, folder, "boosted_trees", trees=10, depth=4)


@query("ml3_random_forest")
def ml3(spark, folder):
    return _evaluated(spark, folder, "random_forest", trees=20, depth=6)


@query("ml4_logistic_regression")
def ml4(spark, folder):
    return _evaluated(spark, folder, "logistic_regression")


@query("ml5_isolation_forest")
def ml5(spark, folder):
    rows = _split(spark, folder)
    forest = learners.fit_isolation_forest(rows.where("part = 'train'"), "transaction_id", trees=50)
    return rows.where("part = 'validation'").select("transaction_id", forest.score().alias("score"))


@query("ml11_feature_importance")
def ml11(spark, folder):
    rows = _split(spark, folder)
    return learners.importance(spark, learners.fit("random_forest", rows.where("part = 'train'"), trees=20, depth=6))


@query("top9_feature_importance")
def top9(spark, folder):
    rows = _split(spark, folder)
    return learners.importance(spark, learners.fit("logistic_regression", rows.where("part = 'train'")))


@query("ml12_tree_attribution")
def ml12_tree(spark, folder):
    rows = _split(spark, folder)
    model = learners.fit("boosted_trees", rows.where("part = 'train'"), trees=5, depth=3)
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), learners.tree_attribution(model))
    return rows.where("part = 'validation'").select("transaction_id", F.inline(attribution.strongest(values, 8)))


@query("ml12_linear_attribution")
def ml12_linear(spark, folder):
    rows = _split(spark, folder)
    model = learners.fit("logistic_regression", rows.where("part = 'train'"))
    return rows.where("part = 'validation'").select("transaction_id", F.inline(attribution.strongest(learners.linear_attribution(model), 8)))


@query("ml13_model_scoring")
def ml13_model(spark, folder):
    rows = _split(spark, folder)
    model = learners.fit("logistic_regression", rows.where("part = 'train'"))
    scored = learners.score(model, rows).withColumn("risk_score", F.col("score"))
    return scored.select("transaction_id", "risk_score", decisions.verdict(F.col("risk_score")).alias("risk_label"))


@query("src20_model_registry")
def src20(spark, folder):
    root = files.scratch(spark, "registry")
    rows = _split(spark, folder)
    train, validation = rows.where("part = 'train'"), rows.where("part = 'validation'")
    for run_id, algorithm, hp in (("run-a", "logistic_regression", {"C": 1.0}), ("run-b", "random_forest", {"trees": 5, "depth": 4})):
        model = learners.fit(algorithm, train, **hp)
        metrics = _metrics(learners.score(model, validation)).first().asDict()
        learners.save_run(spark, root, run_id, algorithm, model, metrics, hp)
    learners.promote(spark, root, "run-b")
    again = learners.score(learners.load_champion(spark, root), validation)
    check = again.agg(F.count(F.lit(1)).alias("rescored"))
    return learners.runs(spark, root).select("run_id", "algorithm", "auc", "fpr", "champion").withColumn("rescored", F.lit(check.first().rescored))
