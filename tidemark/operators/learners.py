"""Learners over evidence columns: forests as expressions, ridge from aggregates, and Spark ML estimators behind one contract."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.relation import Relation, num

#: A split: (column, threshold, left, right); values up to the threshold and null ones go left. A leaf is a number.
Tree = float | tuple


def tree_sql(tree: Tree) -> str:
    if not isinstance(tree, tuple):
        return num(tree)
    column, threshold, left, right = tree
    return f"CASE WHEN {column} > {num(threshold)} THEN {tree_sql(right)} ELSE {tree_sql(left)} END"


def forest_score(rows: Relation, trees: list[Tree], bias: float = 0.0) -> Relation:
    """Adds margin (the sum of the trees' leaves) and p (its logistic); the planner compiles the trees into one stage."""
    return rows.add(margin=" + ".join([num(bias), *(tree_sql(t) for t in trees)])).add(p="1e0 / (1e0 + exp(-margin))")


def forest_bound(trees: list[Tree], bias: float = 0.0) -> float:
    """No score exceeds this: each tree's largest leaf, whether or not they can meet."""

    def top(tree: Tree) -> float:
        return max(top(tree[2]), top(tree[3])) if isinstance(tree, tuple) else tree

    return float(1 / (1 + np.exp(-(bias + sum(map(top, trees)) + 1e-10))))


def exported(model, columns: list[str]) -> tuple[list[Tree], float]:
    """The trees of a fitted GBTClassificationModel as splits over columns; its margin is twice their weighted sum."""

    def walk(node, weight: float) -> Tree:
        if node.subtreeDepth() == 0:
            return 2 * weight * node.prediction()
        split = node.split()
        return columns[split.featureIndex()], split.threshold(), walk(node.leftChild(), weight), walk(node.rightChild(), weight)

    return [walk(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights, strict=True)], 0.0


def varying(rows: DataFrame, columns: list[str], least: float = 1e-12) -> list[str]:
    """The columns that aren't constant."""
    spread = rows.agg(*((F.max(c) - F.min(c)).alias(c) for c in columns)).first()
    return [c for c in columns if spread[c] is not None and spread[c] > least]


def ridge_fit(rows: DataFrame, columns: list[str], response: str, weight: str | None = None, alpha: float = 100.0) -> dict:
    """Weighted ridge on standardised columns with a free intercept, from one pass of sums; only a matrix of the columns' size reaches the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    every = [*columns, response]
    sums = rows.agg(F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(f"s_{c}") for c in every), *(F.sum(w * F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(every) for b in every[i:])).first().asDict()
    mean = np.array([sums[f"s_{c}"] / sums["w"] for c in every])
    cross = np.array([[sums[f"p_{a}_{b}"] if i <= j else sums[f"p_{b}_{a}"] for j, b in enumerate(every)] for i, a in enumerate(every)]) / sums["w"] - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cross)[:-1], 1e-12))
    gram, right = cross[:-1, :-1] / np.outer(scale, scale) * sums["w"], cross[:-1, -1] / scale * sums["w"]
    k = np.linalg.solve(gram + alpha * np.eye(len(columns)), right) / scale
    return {"columns": columns, "coefficients": k.tolist(), "intercept": float(mean[-1] - k @ mean[:-1])}


def ridge_cross_fit(rows: DataFrame, columns: list[str], response: str, fold: str = "fold", alpha: float = 100.0, name: str = "p") -> DataFrame:
    """rows with out-of-fold scores: sums by fold in one pass, and each fold's model from the sums of the others."""
    every = [*columns, response]
    pairs = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    sums = rows.groupBy(fold).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in every), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs)).collect()
    total = {k: sum(r[k] for r in sums) for k in sums[0].asDict() if k != fold} if sums else {}
    score = F.lit(None).cast("double")
    for r in sums:
        rest = {k: v - r[k] for k, v in total.items()}
        n = max(rest["n"], 1)
        mean = np.array([rest[f"s_{c}"] / n for c in every])
        cross = np.zeros((len(every), len(every)))
        for a, b in pairs:
            i, j = every.index(a), every.index(b)
            cross[i, j] = cross[j, i] = rest[f"p_{a}_{b}"] / n
        cross -= np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cross)[:-1], 1e-12))
        k = np.linalg.solve(cross[:-1, :-1] / np.outer(scale, scale) * n + alpha * np.eye(len(columns)), cross[:-1, -1] / scale * n) / scale
        line = F.lit(float(mean[-1] - k @ mean[:-1]))
        for c, v in zip(columns, k, strict=True):
            line = line + F.lit(float(v)) * F.col(c)
        score = F.when(F.col(fold) == r[fold], line).otherwise(score)
    return rows.withColumn(name, score)


def linear_score(rows: DataFrame, model: dict, name: str = "p") -> DataFrame:
    total = F.lit(model["intercept"])
    for c, k in zip(model["columns"], model["coefficients"], strict=True):
        total = total + F.lit(k) * F.col(c)
    return rows.withColumn(name, total)


def _assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows)


def logistic(train: DataFrame, test: DataFrame, columns: list[str], label: str = "y", weight: str | None = None, penalty: float = 0.1) -> DataFrame:
    """test with p from a ridge logistic regression on standardised columns."""
    train, test = _assembled(train, columns), _assembled(test, columns)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=penalty, standardization=False, **({"weightCol": weight} if weight else {})).fit(scaler.transform(train))
    return model.transform(scaler.transform(test)).withColumn("p", vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def boosted(train: DataFrame, columns: list[str], label: str = "y", weight: str | None = None, trees: int = 20, depth: int = 3):
    """A gradient-boosted classifier; exported() gives it as expressions."""
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7, **({"weightCol": weight} if weight else {})).fit(_assembled(train, columns))


def offset_logistic(train: DataFrame, test: DataFrame, columns: list[str], offset: str, label: str = "y") -> DataFrame:
    """test with p from a logistic correction whose offset, a logit, has the fixed coefficient 1."""
    model = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=label, offsetCol=offset, regParam=0.01, maxIter=25).fit(_assembled(train, columns))
    return model.transform(_assembled(test, columns)).withColumnRenamed("prediction", "p").drop("features")


def contract(columns: list[str], settings: dict) -> str:
    """The hash that a stored model must match."""
    return hashlib.sha256(json.dumps([columns, settings], sort_keys=True).encode()).hexdigest()


def save(spark, path: str, model: dict, columns: list[str], settings: dict) -> None:
    """Write a model's parameters and contract once; an existing path is an error."""
    spark.createDataFrame([(contract(columns, settings), json.dumps(model, sort_keys=True))], "contract string, model string").coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark, path: str, columns: list[str], settings: dict) -> dict:
    row = spark.read.parquet(path).first()
    if row.contract != contract(columns, settings):
        raise ValueError("the stored model is for other columns or settings")
    return json.loads(row.model)
