"""Classifiers of findings that Spark's own library trains, on the cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a missed vulnerability weighs against a false alarm.
MISS_WEIGHT = 3.5


def weighted(train: DataFrame, label: str = "label") -> DataFrame:
    return train.withColumn("weight", F.when(F.col(label) == 1, F.lit(MISS_WEIGHT)).otherwise(F.lit(1.0)))


def boosted(train: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees over numeric columns, false negatives weighing more."""
    model = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), model]).fit(weighted(train, label))


def text_features(text: str = "code", size: int = 5000) -> list:
    """TF-IDF over code tokens and pairs of them."""
    return [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"\$?\w+|[^\s\w]", gaps=False),
        NGram(n=2, inputCol="tokens", outputCol="pairs"),
        CountVectorizer(inputCol="tokens", outputCol="tf1", vocabSize=size, minDF=2),
        CountVectorizer(inputCol="pairs", outputCol="tf2", vocabSize=size, minDF=2),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf"),
    ]


def scored(model: PipelineModel, rows: DataFrame, name: str = "ml_score") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features")


def stacked(train: DataFrame, features: list[str], label: str = "label", folds: int = 3, key: str = "id", seed: int = 7):
    """Boosted trees and a forest, each scored out of fold by a hash of the row's key, and logistic regression over both scores. Gives a function from rows to rows with ml_score."""
    train = weighted(train, label).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    build = lambda rows: [boosted(rows, features, label, seed=seed), Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=20, maxDepth=6, seed=seed)]).fit(rows)]
    both = lambda models, rows: scored(models[1], scored(models[0], rows, "gbt"), "forest")
    held = None
    for k in range(folds):
        part = both(build(train.where(F.col("fold") != k)), train.where(F.col("fold") == k))
        held = part if held is None else held.unionByName(part)
    assemble = VectorAssembler(inputCols=["gbt", "forest"], outputCol="stack")
    meta = LogisticRegression(featuresCol="stack", labelCol=label, weightCol="weight").fit(assemble.transform(held))
    models = build(train)

    def score(rows: DataFrame) -> DataFrame:
        return meta.transform(assemble.transform(both(models, rows))).withColumn("ml_score", vector_to_array("probability")[1]).drop("stack", "rawPrediction", "probability", "prediction")

    return score


def anomaly(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Distance of each row from the training rows' centre, in standard deviations, over all features: rows of one sort lie near."""
    stats = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    squares = [F.when(F.col(f"s_{c}") > 0, F.pow((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 2)).otherwise(0.0) for c in features]
    return rows.crossJoin(F.broadcast(stats)).withColumn("anomaly", F.sqrt(sum(squares, F.lit(0.0)))).select(*rows.columns, "anomaly")  # stats is one row


#: Of an isolation forest: trees, rows that each is grown on, and rows that these are drawn from, at most.
TREES, ROWS_OF_TREE, CANDIDATES = 100, 256, 4096


def expected_depth(n: int) -> float:
    """How deep a search that fails goes on average in a search tree of n random keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grown(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, int]]:
    """(node, feature, split, rows) of a tree over the rows of x: node k's children are 2k + 1 and 2k + 2; a leaf's feature is -1."""
    most, out, work = int(np.ceil(np.log2(max(len(x), 2)))), [], [(0, 0, x)]
    while work:
        node, depth, own = work.pop()
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(x.shape[1]),) * 2
        open_ = np.flatnonzero(high > low)
        if depth == most or not len(open_):
            out.append((node, -1, 0.0, len(own)))
            continue
        f = int(rng.choice(open_))
        split = float(rng.uniform(low[f], high[f]))
        out.append((node, f, split, len(own)))
        left = own[:, f] <= split
        work += [(2 * node + 1, depth + 1, own[left]), (2 * node + 2, depth + 1, own[~left])]
    return out


def isolation_forest(train: DataFrame, features: list[str], trees: int = TREES, seed: int = 7) -> DataFrame:
    """(tree, node, feature, split, n): trees of random splits, each over up to ROWS_OF_TREE rows.

    These are drawn by hash from a sample of CANDIDATES rows, so what is gathered is bounded; nulls are 0. Each tree is
    grown in a task of its own.
    """
    columns = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    names = [f"x{i}" for i in range(len(features))]
    drawn = train.select(*columns).withColumn("h", F.xxhash64(F.lit(seed), *names)).orderBy("h", *names).limit(CANDIDATES)
    by_tree = drawn.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), *names).withColumn("h", F.xxhash64("tree", F.lit(seed), *names))
    of_tree = by_tree.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("h", *names))).where(F.col("r") <= ROWS_OF_TREE)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        made = _grown(frame.sort_values("r")[names].to_numpy(), np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *m) for m in made], columns=["tree", "node", "feature", "split", "n"])

    return of_tree.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, split double, n int")


def isolated(forest: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with `anomaly`, from 0 to 1: the sooner random splits part a row from others, the higher. The forest has TREES times twice ROWS_OF_TREE nodes at most, which go to each task."""
    nodes = forest.orderBy("tree", "node").toPandas()
    trees, size = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    feature, split, depth = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    at = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    feature[at], split[at] = nodes["feature"], nodes["split"]
    depth[at] = np.floor(np.log2(at[1] + 1)) + nodes["n"].map(expected_depth)
    scale = expected_depth(int(nodes[nodes["node"] == 0]["n"].max())) or 1.0
    steps = int(np.ceil(np.log2(size + 1)))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.fillna(0.0).to_numpy() for c in columns])
        total = np.zeros(len(x))
        for t in range(trees):
            here = np.zeros(len(x), np.int64)
            for _ in range(steps):
                f = feature[t, here]
                on = 2 * here + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > split[t, here])
                here = np.where(f < 0, here, on)
            total += depth[t, here]
        return pd.Series(np.exp2(-total / trees / scale))

    return rows.withColumn("anomaly", score(*[F.col(f"`{c}`").cast("double") for c in features]))


def importances(model: PipelineModel, features: list[str], n: int = 15) -> list[tuple[str, float]]:
    """The n features that a tree model leans on most, with their shares."""
    shares = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, shares, strict=True), key=lambda x: (-x[1], x[0]))[:n]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def per_type(train: DataFrame, groups: dict[str, list[str]], features: list[str], vuln_type: str = "vuln_type", label: str = "label", least: int = 100) -> dict[str, PipelineModel]:
    """A model of its own for each group of types with enough rows of both labels."""
    sizes = {r[0]: (r["n"], r["y"]) for r in train.groupBy(group_of(groups, vuln_type).alias("g")).agg(F.count("*").alias("n"), F.sum(label).alias("y")).collect()}  # a row for each group
    enough = [g for g in groups if g in sizes and sizes[g][0] >= least and 0 < sizes[g][1] < sizes[g][0]]
    return {g: boosted(train.where(group_of(groups, vuln_type) == g), features, label) for g in enough}


def group_of(groups: dict[str, list[str]], vuln_type: str = "vuln_type"):
    out = F.lit("other")
    for g, types in groups.items():
        out = F.when(F.col(vuln_type).isin(types), g).otherwise(out)
    return out


def cross_validated(rows: DataFrame, features: list[str], label: str = "label", key: str = "id", folds: int = 3) -> list[float]:
    """F2 of each fold, folds by a hash of the row's key."""
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    return [f2(scored(boosted(rows.where(F.col("fold") != k), features, label), rows.where(F.col("fold") == k)), 0.5, label) for k in range(folds)]


def f2(scored_rows: DataFrame, threshold: float, label: str = "label", score: str = "ml_score") -> float:
    """F-measure in which recall weighs twice."""
    p, y = F.col(score) >= threshold, F.col(label) == 1
    r = scored_rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn")).first()
    return 5 * r.tp / max(1, 5 * r.tp + 4 * r.fn + r.fp)
