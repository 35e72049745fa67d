"""Model runners on MLlib.

MLlib has no learning-to-rank objective. Two rankers are built on its trees:
``listwise`` boosts regression trees on the gradient of a softmax over each
event's entries, so it optimises order within an event; ``pointwise`` regresses
log1p(relevance label) with gradient boosted trees. Entries are ranked per
event by the score. Scores differ from a LambdaRank learner; the metrics that
judge them are exact. A training set is its features and label
only, written once as parquet in the shared checkpoint folder: the learner
reads it for every tree, its partitions follow its size, and a lost executor
re-reads files.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import relevance_of
from ..session import materialize
from ..spec import FEATURES, PanelSpec, Params

DEFAULT_SPEC = PanelSpec()
MISSING = -1.0


def assemble(df: DataFrame, features: Sequence[str] = FEATURES, out: str = "features",
             categorical: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Feature vector: each numeric feature with nulls as a sentinel plus an
    is-missing indicator, so no row is dropped (nulls are meaningful, e.g.
    no second ranking in the event); ``categorical`` index columns go in as
    they are, so the learner sees their categories. ``keep``: the other
    columns of the result (default: all)."""
    cols, names = [], []
    for c in features:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        cols += [F.coalesce(v, F.lit(MISSING)).alias(f"_f_{c}"), v.isNull().cast("double").alias(f"_m_{c}")]
        names += [f"_f_{c}", f"_m_{c}"]
    kept = df.columns if keep is None else [c for c in keep if c not in categorical]
    tmp = df.select(*kept, *([] if keep is None else categorical), *cols)
    made = VectorAssembler(inputCols=[*names, *categorical], outputCol=out).transform(tmp)
    return made.drop(*names, *([] if keep is None else categorical))


def index_categoricals(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str],
                       max_categories: int = 256):
    """Category columns -> indices fitted on the training split; unseen
    categories get their own index (``handleInvalid="keep"``). A tree must look
    at all categories of a column at once, so columns of more than
    ``max_categories`` values raise: ``encode.category_rates`` takes any number.
    Returns (train, others, index column names)."""
    from pyspark.ml.feature import StringIndexer
    counts = train.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    wide = [c for c in cols if counts[c] > max_categories]
    if wide:
        raise ValueError(f"too many categories to index, use category_rates: {wide}")
    used = [c for c in cols if counts[c] > 0]
    if not used:
        return train, list(others), []
    names = [f"{c}__idx" for c in used]
    model = StringIndexer(inputCols=used, outputCols=names, handleInvalid="keep",
                          stringOrderType="alphabetAsc").fit(train)
    return model.transform(train), [model.transform(o) for o in others], names


def feature_names(features: Sequence[str] = FEATURES, categorical: Sequence[str] = ()) -> list[str]:
    """Source feature of every slot of the vector."""
    return [c for c in features for _ in range(2)] + list(categorical)


def _training(df: DataFrame, features: Sequence[str], categorical: Sequence[str], label,
              keep: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Features, label and ``keep``, written once, and the bins that the largest category needs."""
    data = assemble(df.withColumn("_label", label), features, categorical=categorical, keep=["_label", *keep])
    bins = 32
    for attr in (data.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])):
        bins = max(bins, len(attr.get("vals", [])) + 1)
    meta = data.schema["features"].metadata
    stored = materialize(data, "training-set")
    return stored.withColumn("features", F.col("features").alias("features", metadata=meta)), bins


def fit_ranker(train: DataFrame, features: Sequence[str] = FEATURES, trees: int = 150, rate: float = 0.05,
               depth: int = 5, min_rows: int = 20, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
               categorical: Sequence[str] = (), method: str = "pointwise"):
    """Ranker (M1): ``pointwise``, GBT regression on log1p(relevance), or ``listwise``, see ``fit_listwise``."""
    if method == "listwise":
        return fit_listwise(train, features, trees, rate, depth, min_rows, params, spec, categorical)
    if method != "pointwise":
        raise ValueError(f"unknown ranking method {method!r}")
    data, bins = _training(train, features, categorical, F.log1p(relevance_of(spec.outcome).cast("double")))
    return pointwise_trees(data, trees, rate, depth, min_rows, params, bins)


def pointwise_trees(data: DataFrame, trees: int, rate: float, depth: int, min_rows: int, params: Params, bins: int = 32,
                    extremes: DataFrame | None = None):
    """GBT regression on a stored table of ``features`` and ``_label``. ``extremes``: see ``fit_varying``."""
    return fit_varying(GBTRegressor(featuresCol="features", labelCol="_label", maxIter=trees, stepSize=rate,
                                    maxDepth=depth, minInstancesPerNode=min_rows, seed=params.seed, maxBins=bins,
                                    checkpointInterval=10), data, extremes)


def cached_row_bytes(slots: int) -> int:
    """About what the boosted trees keep cached of a training row: a bin a slot, objects, residual and two predictions."""
    return 160 + 4 * slots


class SlicedModel:
    """A model fitted on some slots of the feature vector; takes and reports the whole vector's."""

    def __init__(self, model, slots: list[int], size: int):
        self.model, self.slots, self.size = model, slots, size

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(slice_slots(df, self.slots)).drop("_slots")

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        return Vectors.sparse(self.size, self.slots, self.model.featureImportances.toArray())

    @property
    def toDebugString(self) -> str:
        """The trees, with the whole vector's slot numbers."""
        return re.sub(r"\bfeature (\d+)", lambda m: f"feature {self.slots[int(m[1])]}", self.model.toDebugString)


def slice_slots(df: DataFrame, slots: list[int]) -> DataFrame:
    return VectorSlicer(inputCol="features", outputCol="_slots", indices=slots).transform(df)


def fit_varying(learner, data: DataFrame, extremes: DataFrame | None = None):
    """``learner`` fitted on the slots that are not constant over ``data`` (one pass of minima and maxima tells): no
    tree can split at the others, such as indicators of features that are never missing, so the trees are the same,
    and each pass over the rows counts fewer of them. ``extremes``: a smaller table whose ``features`` have the minima
    and maxima of those of ``data``, read instead."""
    seen = data if extremes is None else extremes
    found = seen.select(Summarizer.metrics("min", "max").summary(F.col("features")).alias("s")).select("s.*").first()
    slots = [i for i, (low, high) in enumerate(zip(found["min"], found["max"], strict=True)) if low != high]
    if not slots or len(slots) == len(found["min"]):
        return learner.fit(data)
    model = learner.copy().setFeaturesCol("_slots").fit(slice_slots(data, slots))
    return SlicedModel(model, slots, len(found["min"]))


class ListwiseRanker:
    """Sum of regression trees whose leaves carry their own values."""

    def __init__(self, spark):
        self.spark, self.trees = spark, []  # (tree model, {leaf: value})

    def add(self, tree, leaves: dict[int, float]) -> None:
        self.trees.append((tree, leaves))

    @staticmethod
    def step(df: DataFrame, tree, leaves: dict[int, float], score: str) -> DataFrame:
        """``df`` with the tree's value added to ``score``."""
        table = F.create_map(*[F.lit(x) for leaf, value in leaves.items() for x in (float(leaf), float(value))])
        out = tree.setLeafCol("_leaf").setPredictionCol("_tree").transform(df)
        return out.withColumn(score, F.col(score) + F.coalesce(F.element_at(table, F.col("_leaf")), F.lit(0.0))) \
            .drop("_leaf", "_tree")

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("prediction", F.lit(0.0))
        for tree, leaves in self.trees:
            out = self.step(out, tree, leaves, "prediction")
        return out

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import Vectors
        total = sum(tree.featureImportances.toArray() for tree, _ in self.trees)
        return Vectors.dense(total / max(total.sum(), 1e-300))


def fit_listwise(train: DataFrame, features: Sequence[str] = FEATURES, trees: int = 150, rate: float = 0.05,
                 depth: int = 5, min_rows: int = 20, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                 categorical: Sequence[str] = (), checkpoint_every: int = 5) -> ListwiseRanker:
    """Listwise ranker (M1): boosting on the cross entropy between each event's target shares (relevance over the
    event's sum) and the softmax of its scores.

    The gradient of an entry is its target share minus its score share, so a
    round needs one sum per event and no pairs: a grouped sum joined back. A
    regression tree is fitted to the gradients, scaled by the event's size; a
    leaf's value is its Newton step, from grouped sums over at most 2^depth
    leaves. Scores are written every ``checkpoint_every`` rounds, which cuts the
    lineage; a lost executor re-reads files.
    """
    from pyspark.ml.regression import DecisionTreeRegressor
    gain = relevance_of(spec.outcome).cast("double")
    stored, bins = _training(train.filter(F.col(spec.event).isNotNull()), features, categorical, gain, [spec.event])
    meta = {"metadata": stored.schema["features"].metadata}
    data = stored.withColumn("_score", F.lit(0.0))
    model = ListwiseRanker(train.sparkSession)
    for done in range(trees):
        # shares of each event; scores are bounded so that no weight overflows
        weight = F.exp(F.least(F.greatest(F.col("_score"), F.lit(-50.0)), F.lit(50.0)))
        sums = data.groupBy(spec.event).agg(F.sum(weight).alias("_w"), F.sum("_label").alias("_g"),
                                            F.count(F.lit(1)).alias("_n"))
        share, target = weight / F.col("_w"), F.try_divide(F.col("_label"), F.col("_g"))
        rows = data.join(sums, spec.event).select(
            "features", ((F.coalesce(target, 1 / F.col("_n")) - share) * F.col("_n")).alias("_step"),
            (share * (1 - share) * F.col("_n")).alias("_curve"))
        rows = materialize(rows, "listwise-round").withColumn("features", F.col("features").alias("features", **meta))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="_step", maxDepth=depth, maxBins=bins,
                                     minInstancesPerNode=min_rows, seed=params.seed, leafCol="_leaf").fit(rows)
        found = tree.transform(rows).groupBy("_leaf").agg(F.sum("_step").alias("s"), F.sum("_curve").alias("c")).collect()
        leaves = {int(r["_leaf"]): rate * r["s"] / (r["c"] + 1.0) for r in found}
        model.add(tree, leaves)
        data = model.step(data, tree, leaves, "_score")
        if (done + 1) % checkpoint_every == 0 and done + 1 < trees:
            data = materialize(data, "listwise-scores").withColumn("features", F.col("features").alias("features", **meta))
    return model


def score_ranker(model, df: DataFrame, features: Sequence[str] = FEATURES, score: str = "score",
                 pos: str = "pred_pos", spec: PanelSpec = DEFAULT_SPEC, skew_safe: bool = False,
                 categorical: Sequence[str] = ()) -> DataFrame:
    """Score, then rank per event by score descending, ties share."""
    scored = model.transform(assemble(df, features, categorical=categorical)).withColumnRenamed(
        "prediction", score).drop("features")
    if skew_safe:
        from ..functions.ranking import distributed_rank
        return distributed_rank(scored, [spec.event], [(score, False)], pos)
    return scored.withColumn(pos, F.rank().over(
        Window.partitionBy(spec.event).orderBy(F.col(score).desc_nulls_last())).cast("bigint"))


def fit_classifier(train: DataFrame, features: Sequence[str] = FEATURES, trees: int = 100, rate: float = 0.05,
                   depth: int = 4, params: Params = Params(), label: str = "is_classified",
                   categorical: Sequence[str] = ()):
    """P(classified) with gradient boosted trees (M2)."""
    data, bins = _training(train, features, categorical, F.col(label).cast("double"))
    return fit_varying(GBTClassifier(featuresCol="features", labelCol="_label", maxIter=trees, stepSize=rate, maxBins=bins,
                                     maxDepth=depth, seed=params.seed, checkpointInterval=10), data)


def classify(model, df: DataFrame, features: Sequence[str] = FEATURES, params: Params = Params(),
             categorical: Sequence[str] = ()) -> DataFrame:
    """Adds survival_prob and predicted_classified."""
    out = model.transform(assemble(df, features, categorical=categorical))
    return out.withColumn("survival_prob", vector_to_array("probability")[1]) \
              .withColumn("predicted_classified",
                          (F.col("survival_prob") >= F.lit(params.classify_threshold)).cast("bigint")) \
              .drop("features", "rawPrediction", "probability", "prediction")


def two_stage_rank(train: DataFrame, test: DataFrame, features: Sequence[str] = FEATURES,
                   params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                   ranker_kw: dict | None = None, classifier_kw: dict | None = None,
                   categorical: Sequence[str] = (), skew_safe: bool = False) -> DataFrame:
    """M2 on all entries, M1 on classified entries only, merged (P28): entries
    predicted to finish come first by rank score, the others after them by
    survival probability. Ordered by two keys, not an offset (Q24).
    ``categorical`` columns, of any width, become rates of being classified and
    mean outcomes over earlier events of the training split (P25). The ranker
    alone over all entries is ``single_stage_pred_pos``."""
    if categorical:
        train, test, names = encode_split(train, test, categorical, spec)
        features = [*features, *names]
    clf = fit_classifier(train, features, params=params, **(classifier_kw or {}))
    rk = fit_ranker(train.filter(F.col("is_classified") == 1), features, params=params, spec=spec, **(ranker_kw or {}))
    t = classify(clf, test, features, params)
    t = rk.transform(assemble(t, features)).withColumnRenamed("prediction", "rank_score").drop("features")
    return merge_stages(t, spec, skew_safe)


def encode_split(train: DataFrame, test: DataFrame, cols: Sequence[str],
                 spec: PanelSpec = DEFAULT_SPEC) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both splits with the ordered rates of ``cols``; outcomes of the test split count for nobody."""
    from .encode import category_rates
    both = train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)),
                                                               allowMissingColumns=True)
    flag = F.when(~F.col("_test"), F.col("is_classified"))
    place = F.when(~F.col("_test"), F.col(spec.outcome))
    done = materialize(category_rates(category_rates(both, cols, flag, "rate", spec=spec), cols, place, "place",
                                      fill=10.0, spec=spec), "encoded-split")
    names = [f"{c}__{kind}" for c in cols for kind in ("rate", "place")]
    return (done.filter("NOT _test").select(*train.columns, *names), done.filter("_test").select(*test.columns, *names),
            names)


def merge_stages(t: DataFrame, spec: PanelSpec = DEFAULT_SPEC, skew_safe: bool = False) -> DataFrame:
    """Positions from ``predicted_classified``, ``rank_score`` and ``survival_prob``."""
    t = t.withColumn("_key2", F.when(F.col("predicted_classified") == 1, F.col("rank_score"))
                     .otherwise(F.col("survival_prob")))
    if skew_safe:
        from ..functions.ranking import Rank, distributed_ranks
        return distributed_ranks(materialize(t, "two-stage-scores"), [
            Rank([spec.event], [("predicted_classified", False), ("_key2", False)], "two_stage_pred_pos"),
            Rank([spec.event], [("rank_score", False)], "single_stage_pred_pos")]).drop("_key2")
    w = Window.partitionBy(spec.event)
    return t.withColumn("two_stage_pred_pos", F.rank().over(w.orderBy(
        F.col("predicted_classified").desc(), F.col("_key2").desc_nulls_last())).cast("bigint")) \
        .withColumn("single_stage_pred_pos", F.rank().over(w.orderBy(
            F.col("rank_score").desc_nulls_last())).cast("bigint")).drop("_key2")


def importances(model, names: Sequence[str], spark) -> DataFrame:
    """Feature importances summed per source feature, sorted descending.
    ``names``: the source feature of every slot of the vector."""
    total: dict[str, float] = {}
    for name, v in zip(names, model.featureImportances.toArray(), strict=True):
        total[name] = total.get(name, 0.0) + float(v)
    return spark.createDataFrame(list(total.items()), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


ALARM_MEMORY_MB = 2
LEAK_DENY = ("raceId", "driverId", "constructorId", "positionOrder", "status", "is_classified")


def leakage_alarm(df: DataFrame, params: Params = Params(), spec: PanelSpec = DEFAULT_SPEC,
                  deny: Sequence[str] = LEAK_DENY) -> DataFrame:
    """Random forest on every numeric column but the deny list, nulls as 0;
    alarm when the top importance exceeds the threshold (M6, P26).

    Returns the importance table with an ``alarm`` flag per row (same value).
    """
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "long", "integer", "float", "short")
               and f.name not in deny]
    data = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
                     F.col(spec.outcome).cast("double").alias("_label")) \
             .filter(F.col("_label").isNotNull())
    data = materialize(VectorAssembler(inputCols=numeric, outputCol="features").transform(data).select(
        "features", "_label"), "alarm-set")
    # a pass over the rows counts few nodes, whose sums fit a core's cache; the trees are the same
    model = RandomForestRegressor(featuresCol="features", labelCol="_label", numTrees=50, maxDepth=5,
                                  featureSubsetStrategy="all", seed=params.seed, maxMemoryInMB=ALARM_MEMORY_MB).fit(data)
    imp = importances(model, numeric, df.sparkSession)
    top = imp.agg(F.max("importance").alias("_top")).scalar()
    return imp.withColumn("alarm", top > F.lit(params.leakage_threshold))
