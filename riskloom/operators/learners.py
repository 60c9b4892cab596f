"""Models on the training contract: preparation, fitting with Spark ML, isolation forest, explanations, registry."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.contracts import FEATURES
from riskloom.operators.ordered import SLICE, running, slice_ordered
from riskloom.operators.ranking import chronological_split

SEED = 42


# ---------------------------------------------------------------- preparation

def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the rank of each value in text order, starting at 0. Missing values count as ``unknown``."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).distinct()
    ranked = running(slice_ordered(values, [], ["value"]), [], ["value"], {"_n": ("count", F.lit(1))})
    return ranked.select("value", (F.col("_n") - 1).cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Replace a column by its codes; unseen values take the code of ``unknown``, or 0 without one."""
    fallback = codes.where(F.col("value") == "unknown").select("code").first()
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    out = df.withColumn("_value", F.coalesce(F.col(column).cast("string"), F.lit("unknown"))).join(named, "_value", "left")
    return out.withColumn(column, F.coalesce("_code", F.lit(fallback.code if fallback else 0))).drop("_value", "_code")


def prepare(df: DataFrame, categorical: list[str], numeric: list[str], order: list[str], share: float = 0.8) -> DataFrame:
    """Encode, fill missing numbers with -999, and split by time."""
    for column in categorical:
        df = encode(df, label_codes(df, column), column)
    return chronological_split(df.fillna(-999.0, subset=numeric), order, share)


def align(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """The columns a model wants, in its order; absent ones appear with their missing value."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(-999.0)) if c in df.columns else F.lit(-999.0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in df.columns else F.lit("unknown")
    others = [c for c in df.columns if c not in numeric and c not in categorical]
    return df.select(*others, *[number(c).alias(c) for c in numeric], *[text(c).alias(c) for c in categorical])


def retraining_set(alerts: DataFrame, latest_feedback: DataFrame) -> DataFrame:
    """Features of reviewed alerts with the latest disposition as label: confirmed 1, false positive 0."""
    label = F.when(F.col("label") == "confirmed_fraud", 1).when(F.col("label") == "false_positive", 0)
    reviewed = latest_feedback.select(F.col("alert_id").alias("id"), label.alias("is_fraud")).where(F.col("is_fraud").isNotNull())
    return alerts.select("id", "tx_count_5m", "tx_count_1h", "tx_count_24h", "sum_amount_1h", "device_shift").join(reviewed, "id")


# ---------------------------------------------------------------- Spark ML

def estimator(algorithm: str, rows: int, features: list[str] = FEATURES, label: str = "isFraud", **hp) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="raw_features")
    common = {"labelCol": label, "featuresCol": "raw_features"}
    if algorithm == "boosted_trees":
        model = GBTClassifier(maxIter=hp.get("trees", 200), maxDepth=hp.get("depth", 6), stepSize=hp.get("rate", 0.1), seed=SEED, **common)
        return Pipeline(stages=[assembler, model])
    if algorithm == "random_forest":
        model = RandomForestClassifier(numTrees=hp.get("trees", 200), maxDepth=hp.get("depth", 12), seed=SEED, **common)
        return Pipeline(stages=[assembler, model])
    if algorithm == "logistic_regression":
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        model = LogisticRegression(labelCol=label, featuresCol="features", maxIter=hp.get("iterations", 1000),
                                   regParam=1.0 / (hp.get("C", 1.0) * max(rows, 1)), standardization=False)
        return Pipeline(stages=[assembler, scaler, model])
    raise ValueError(algorithm)


def fit(algorithm: str, train: DataFrame, **hp) -> PipelineModel:
    return estimator(algorithm, train.count(), **hp).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of fraud."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return out.drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def importance(spark: SparkSession, model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """(feature, importance), normalised to 1; absolute coefficients for a linear model."""
    last = model.stages[-1]
    raw = last.featureImportances if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    values = np.asarray(raw.toArray() if hasattr(raw, "toArray") else raw, dtype=float)
    total = values.sum() or 1.0
    rows = [(f, float(v / total)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def linear_attribution(model: PipelineModel, features: list[str] = FEATURES) -> Column:
    """Map feature -> coefficient * standardised distance from the mean: exact for a linear score."""
    scaler, linear = model.stages[-2], model.stages[-1]
    pairs = []
    for f, mean, std, w in zip(features, scaler.mean, scaler.std, linear.coefficients):
        pairs += [F.lit(f), (F.col(f) - float(mean)) / float(std or 1.0) * float(w)]
    return F.create_map(*pairs)


def _flat_tree(root) -> np.ndarray:
    """Rows (feature, threshold, left, right, value, training rows) of a fitted tree; leaves have feature -1."""
    rows, queue = [], [root]
    while len(rows) < len(queue):
        node = queue[len(rows)]
        count = node.impurityStats().count()
        if node.subtreeDepth() == 0:
            rows.append((-1, 0.0, 0, 0, node.prediction(), count))
            continue
        split = node.split()
        rows.append((split.featureIndex(), split.threshold(), len(queue), len(queue) + 1, node.prediction(), count))
        queue += [node.leftChild(), node.rightChild()]
    return np.array(rows, dtype=float)


def _leaves(tree: np.ndarray) -> list:
    """(value, {feature: [above, up to, share]}) per leaf: the interval a feature must be in, and the share of training rows that go that way."""
    found, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        feature, threshold, left, right, value, count = tree[at]
        if feature < 0:
            found.append((value, path))
            continue
        above, up_to, share = path.get(int(feature), (-np.inf, np.inf, 1.0))
        part = tree[int(left), 5] / count
        stack.append((int(left), {**path, int(feature): (above, min(up_to, threshold), share * part)}))
        stack.append((int(right), {**path, int(feature): (max(above, threshold), up_to, share * (1 - part))}))
    return found


def _shapley(leaves: list, x: np.ndarray) -> np.ndarray:
    """Shapley values of the features for the rows ``x`` of one tree.

    A feature outside a coalition splits the row by the shares of the training rows. A leaf's value in a coalition is then a product
    over the features on its path, so the sum over coalitions of one size is a coefficient of a polynomial.
    """
    total = np.zeros_like(x)
    for value, path in leaves:
        size = len(path)
        # NaN goes right at every split, as in the model
        inside = {f: np.where(np.isnan(x[:, f]), up_to == np.inf, ((x[:, f] > above) | (above == -np.inf)) & (x[:, f] <= up_to)).astype(float)
                  for f, (above, up_to, _) in path.items()}
        weight = [math.factorial(k) * math.factorial(size - k - 1) / math.factorial(size) for k in range(size)]
        for feature, (_, _, share) in path.items():
            terms = np.zeros((len(x), size))
            terms[:, 0] = 1.0
            for other, (_, _, part) in path.items():
                if other != feature:
                    shifted = np.zeros_like(terms)
                    shifted[:, 1:] = terms[:, :-1] * inside[other][:, None]
                    terms = terms * part + shifted
            total[:, feature] += value * (inside[feature] - share) * (terms @ np.array(weight))
    return total


def tree_attribution(model: PipelineModel, features: list[str] = FEATURES):
    """A column function: array of Shapley values per feature for the sum of the model's trees.

    They add up to that sum less its mean over the training rows. The trees are part of the model and travel with the function;
    rows arrive in Arrow batches.
    """
    last = model.stages[-1]
    trees = [_leaves(_flat_tree(t._call_java("rootNode"))) for t in last.trees]
    weights = list(last.treeWeights)

    @F.pandas_udf("array<double>")
    def contributions(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(list(sum(w * _shapley(leaves, x) for leaves, w in zip(trees, weights))))

    return contributions(*[F.col(f).cast("double") for f in features])


# ---------------------------------------------------------------- isolation forest

def _expected_depth(n) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


@dataclass
class IsolationForest:
    """Random trees as flat arrays (feature, threshold, left, right, path length), and the score range of the fit."""

    trees: list
    sample: int
    features: list
    low: float = 0.0
    high: float = 1.0

    def raw(self) -> Column:
        trees, scale = self.trees, float(_expected_depth(self.sample)) or 1.0

        @F.pandas_udf("double")
        def anomaly(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            depth = np.zeros(len(x))
            for tree in trees:
                at = np.zeros(len(x), dtype=int)
                live = np.flatnonzero(tree[at, 0] >= 0)
                while len(live):
                    feature = tree[at[live], 0].astype(int)
                    at[live] = np.where(x[live, feature] < tree[at[live], 1], tree[at[live], 2], tree[at[live], 3]).astype(int)
                    live = live[tree[at[live], 0] >= 0]
                depth += tree[at, 4]
            return pd.Series(2.0 ** (-depth / len(trees) / scale))

        return anomaly(*[F.col(f).cast("double") for f in self.features])

    def score(self) -> Column:
        """In [0, 1] by the range seen at fit time, so that a single row gets the same score as a batch."""
        return F.least(F.greatest((self.raw() - self.low) / (self.high - self.low + 1e-9), F.lit(0.0)), F.lit(1.0))


def fit_isolation_forest(train: DataFrame, identifier: str, features: list[str] = FEATURES, trees: int = 100,
                         sample: int = 256) -> IsolationForest:
    """Each tree sees its own small subsample, drawn in one scan; trees are grown one per group."""
    rows = train.count()
    fraction = min(1.0, 4.0 * trees * sample / max(rows, 1))
    token = F.xxhash64(F.col(identifier), F.lit(SEED))
    drawn = train.where(F.pmod(token, F.lit(1_000_000)) < fraction * 1_000_000)
    tree = F.pmod(F.xxhash64(F.col(identifier), F.lit(SEED + 1)), F.lit(trees)).cast("int")
    assigned = drawn.select(tree.alias("tree"), token.alias("_token"), *[F.col(f).cast("double").alias(f) for f in features])
    ranked = assigned.withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy("_token")))
    bounded = ranked.where(F.col("_rank") <= sample)
    limit = int(np.ceil(np.log2(sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        x, rng = pdf.sort_values("_rank")[features].to_numpy(), np.random.default_rng(SEED + number)
        out, queue = [], [(np.arange(len(x)), 0)]
        while len(out) < len(queue):
            part, depth = queue[len(out)]
            spread = np.flatnonzero(np.ptp(x[part], axis=0) > 0) if len(part) > 1 else []
            if depth >= limit or len(spread) == 0:
                out.append((number, len(out), -1, 0.0, 0, 0, depth + float(_expected_depth(len(part)))))
                continue
            f = int(rng.choice(spread))
            cut = rng.uniform(x[part, f].min(), x[part, f].max())
            left = x[part, f] < cut
            out.append((number, len(out), f, float(cut), len(queue), len(queue) + 1, 0.0))
            queue += [(part[left], depth + 1), (part[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    grown = bounded.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, depth double").toPandas()  # trees x 2 sample rows at most
    arrays = [g.sort_values("node")[["feature", "cut", "left", "right", "depth"]].to_numpy(dtype=float) for _, g in grown.groupby("tree")]
    forest = IsolationForest(arrays, min(sample, rows), features)
    seen = train.agg(F.min(forest.raw()).alias("low"), F.max(forest.raw()).alias("high")).first()
    forest.low, forest.high = seen.low, seen.high
    return forest


# ---------------------------------------------------------------- registry

RUN = "run_id string, algorithm string, auc double, accuracy double, precision double, recall double, f1 double, fpr double, threshold double, hyperparams string"


def save_run(spark: SparkSession, root: str, run_id: str, algorithm: str, model: PipelineModel, metrics: dict, hyperparams: dict) -> None:
    model.write().overwrite().save(f"{root}/models/{run_id}")
    row = (run_id, algorithm, *[float(metrics[m]) for m in ("auc", "accuracy", "precision", "recall", "f1", "fpr", "threshold")],
           json.dumps(hyperparams, sort_keys=True))
    spark.createDataFrame([row], RUN).write.mode("append").parquet(f"{root}/runs")


def promote(spark: SparkSession, root: str, run_id: str) -> None:
    if spark.read.parquet(f"{root}/runs").where(F.col("run_id") == run_id).limit(1).count() == 0:
        raise KeyError(run_id)
    spark.createDataFrame([(run_id,)], "run_id string").write.mode("overwrite").parquet(f"{root}/champion")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs with a flag on the champion."""
    found = spark.read.parquet(f"{root}/runs")
    try:
        champion = spark.read.parquet(f"{root}/champion").withColumn("champion", F.lit(True))
    except AnalysisException:
        return found.withColumn("champion", F.lit(False))
    return found.join(champion, "run_id", "left").withColumn("champion", F.coalesce("champion", F.lit(False)))


def load_champion(spark: SparkSession, root: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{spark.read.parquet(f'{root}/champion').first().run_id}")
