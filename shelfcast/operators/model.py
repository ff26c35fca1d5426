"""Fitting the wait-time models, one per service, and applying them as columns.

A fitted model is a few hundred nodes. They are kept as rows, and compiled to one expression over the feature columns:
no model object travels with a job, predictions stay inside generated code, and other engines can repeat them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.publishers import label_codes, statistics_of, wait_moments
from shelfcast.operators.scoring import FEATURES, KNOWN, feature_rows
from shelfcast.session import new_path
from shelfcast.sources.sinks import write_snapshot

# features that can be null; each has an indicator, so that a split can tell a missing value from a 0
NULLABLE = ["metacritic_filled", "games_count", "avg_days_to_epic", "publisher_speed_score", "publisher_encoded"]
NODE = "tree int, weight double, node int, prediction double, left int, right int, feature int, threshold double"
# of the items, held out to measure errors
HELD_OUT = 5


@dataclass
class Input:
    """One input of the model: a feature with 0 for null, or whether it is null."""

    feature: str
    missing: bool

    def column(self) -> Column:
        c = F.col(self.feature)
        return c.isNull().cast("double") if self.missing else F.coalesce(c.cast("double"), F.lit(0.0))

    def sql(self) -> str:
        return f"CASE WHEN {self.feature} IS NULL THEN 1.0 ELSE 0.0 END" if self.missing else f"coalesce(CAST({self.feature} AS DOUBLE), 0.0)"

    def name(self) -> str:
        return f"{self.feature}_missing" if self.missing else self.feature


INPUTS = [Input(f, False) for f in FEATURES] + [Input(f, True) for f in NULLABLE]


def fit_trees(features: DataFrame, seed: int = 42, rounds: int = 10, depth: int = 4) -> DataFrame:
    """Boosted trees on the features of items with a known ``wait_days``, as node rows.

    Fitting and prediction turn nulls into the same inputs. Publisher codes come in as a column, so no label list passes
    through the driver. The training rows are written once: fitting reads them repeatedly.
    """
    spark = features.sparkSession
    usable = features.where(F.col("wait_days").isNotNull()).select(
        "path", *[i.column().alias(i.name()) for i in INPUTS], F.col("wait_days").cast("double").alias("wait_days")
    )
    # the path is asked for after writing: before, it would make the features' left join an inner one, whose items could be broadcast
    training = spark.read.schema(usable.schema).parquet(write_snapshot(usable, new_path(spark, "training"))).where(F.col("path") == KNOWN)
    if training.isEmpty():
        return spark.createDataFrame([], NODE)
    vectors = VectorAssembler(inputCols=[i.name() for i in INPUTS], outputCol="features").transform(training)
    fitted = GBTRegressor(featuresCol="features", labelCol="wait_days", maxIter=rounds, maxDepth=depth, seed=seed).fit(vectors)
    path = new_path(spark, "trees")
    fitted.save(path)
    weights = spark.createDataFrame(list(enumerate(fitted.treeWeights)), "tree int, weight double")
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        n["prediction"].alias("prediction"),
        n["leftChild"].alias("left"),
        n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
    )
    return nodes.join(weights, "tree").select(*[c.split()[0] for c in NODE.split(", ")])


def _trees(nodes: DataFrame) -> list[tuple[float, dict[int, dict]]]:
    """Each tree's weight and nodes; at most rounds times 2^(depth + 1) rows."""
    found: dict[int, tuple[float, dict[int, dict]]] = {}
    for r in nodes.orderBy("tree", "node").collect():
        found.setdefault(r["tree"], (r["weight"], {}))[1][r["node"]] = r.asDict()
    return list(found.values())


def days_column(nodes: DataFrame) -> Column:
    """The model as one column over feature rows: null for items that are not scored by it, or without any tree."""

    def of(tree: dict[int, dict], at: int) -> Column:
        node = tree[at]
        if node["left"] < 0:
            return F.lit(node["prediction"])
        goes_left = INPUTS[node["feature"]].column() <= node["threshold"]
        return F.when(goes_left, of(tree, node["left"])).otherwise(of(tree, node["right"]))

    parts = [F.lit(weight) * of(tree, 0) for weight, tree in _trees(nodes)]
    if not parts:
        return F.lit(None).cast("double")
    return F.when(F.col("path") == KNOWN, reduce(lambda a, b: a + b, parts))


def days_sql(nodes: DataFrame) -> str:
    """The same as the text of an SQL expression."""

    def of(tree: dict[int, dict], at: int) -> str:
        node = tree[at]
        if node["left"] < 0:
            return f"CAST({node['prediction']!r} AS DOUBLE)"
        test = f"{INPUTS[node['feature']].sql()} <= CAST({node['threshold']!r} AS DOUBLE)"
        return f"CASE WHEN {test} THEN {of(tree, node['left'])} ELSE {of(tree, node['right'])} END"

    parts = [f"CAST({weight!r} AS DOUBLE) * ({of(tree, 0)})" for weight, tree in _trees(nodes)]
    return f"CASE WHEN path = '{KNOWN}' THEN {' + '.join(parts)} END" if parts else "CAST(NULL AS DOUBLE)"


def service_features(items: DataFrame, first: DataFrame, codes: DataFrame, platform: str) -> DataFrame:
    """Feature rows of the items with one service's statistics, and ``wait_days`` where the item has appeared there."""
    here = first.where(F.col("platform") == platform)
    stats = statistics_of(wait_moments(here, ["publisher"])).select(
        F.lit(0).cast("long").alias("ordinal"),
        F.col("publisher").alias("primary_publisher"),
        F.col("avg_wait_days").alias("avg_days_to_epic"),
        "games_count",
        F.col("avg_score").alias("avg_metacritic"),
    )
    spark = items.sparkSession
    stats = spark.read.schema(stats.schema).parquet(write_snapshot(stats, new_path(spark, "service-statistics")))
    return feature_rows(items, stats, codes)


def _codes(first: DataFrame) -> DataFrame:
    return label_codes(first.select(F.col("publisher").alias("label")))


def wait_predictions(items: DataFrame, first: DataFrame, platforms: list[str], **how: int) -> DataFrame:
    """Days that each item is predicted to wait on each service: game_id, platform, predicted_days, written once.

    ``first`` has one wait per item and platform. The services are a fixed handful, each with a model of its own.
    """
    codes, spark = _codes(first), items.sparkSession
    path = new_path(spark, "predictions")
    for platform in platforms:
        features = service_features(items, first, codes, platform)
        waited = first.where(F.col("platform") == platform).select("game_id", "wait_days")
        nodes = fit_trees(features.join(waited.hint("merge"), "game_id"), **how)
        rows = features.select("game_id", F.lit(platform).alias("platform"), days_column(nodes).alias("predicted_days"))
        rows.write.mode("append").parquet(path)
    return spark.read.schema("game_id long, platform string, predicted_days double").parquet(path)


def held_out_errors(items: DataFrame, first: DataFrame, platforms: list[str], **how: int) -> DataFrame:
    """Mean absolute errors, in days, of each service's model and of the publisher's mean, on items kept from both.

    Every fifth item by a hash is held out; statistics, codes and trees come from the others. Publishers that only
    held-out items have are counted apart.
    """
    spark: SparkSession = items.sparkSession
    out = F.pmod(F.xxhash64("game_id"), F.lit(HELD_OUT)) == 0
    known = first.where(~out)
    codes, path = _codes(known), new_path(spark, "errors")
    for platform in platforms:
        features = service_features(items, known, codes, platform)
        waited = first.where(F.col("platform") == platform).select("game_id", "wait_days")
        nodes = fit_trees(features.join(waited.where(~out).hint("merge"), "game_id"), **how)
        tested = features.join(waited.where(out).hint("merge"), "game_id").withColumn("days", days_column(nodes))
        scored = F.col("days").isNotNull()

        def error(c: str, scored: Column = scored) -> Column:
            return F.avg(F.when(scored, F.abs(F.col(c) - F.col("wait_days"))))

        tested.agg(
            F.count_if(scored).alias("items"),
            F.count_if(~scored).alias("not_scored"),
            error("days").alias("model_error"),
            error("avg_days_to_epic").alias("mean_error"),
        ).select(F.lit(platform).alias("platform"), "*").write.mode("append").parquet(path)
    return spark.read.parquet(path)
