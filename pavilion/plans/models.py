"""Stacked winner and score models.

Three tree ensembles (a forest, histogram boosting and extremely randomised
trees, see ``trees``) and a linear model of Spark ML on top of their
out-of-fold predictions.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..operators.timeline import placed, state_before
from ..session import shuffles_released, written
from . import training, trees
from .trees import Table, Trees

FOLDS = 5


# ---------------------------------------------------------------- preparation


def as_inputs(table: DataFrame, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Numbers as doubles, NULL categories as a category of their own."""
    return table.withColumns({
        **{c: F.col(c).cast("double") for c in numeric},
        **{c: F.coalesce(F.col(c), F.lit("missing")) for c in categorical},
    })


def medians(table: DataFrame, numeric: list[str]) -> DataFrame:
    """One row with the exact median of every column, NULL and NaN left out; the mean of the two middle values of an even number.

    Approximate percentiles bound the middle of each column, and rows are counted on both sides of the bounds.  Only what
    lies between them is counted by distinct value and walked column by column in slots, so no task holds a column.  A
    column without any value has the median 0.
    """
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in numeric}
    bounds = table.agg(*[F.percentile_approx(v, [0.48, 0.52], 100).alias(c) for c, v in known.items()]).first() if numeric else {}
    bounds = {c: tuple(map(float, bounds[c])) for c in numeric if bounds[c]}
    sides = [(F.count_if(known[c] < low).alias(f"{c}_below"), F.count_if(known[c] <= high).alias(f"{c}_until"), F.count(known[c]).alias(f"{c}_rows"))
             for c, (low, high) in bounds.items()]
    size = table.agg(*[n for side in sides for n in side]).first() if sides else None
    pairs, below, rows = [], {}, {}
    for c, (low, high) in bounds.items():
        below[c], rows[c] = size[f"{c}_below"], size[f"{c}_rows"]
        inside = F.col(c).between(low, high)
        if below[c] > (rows[c] - 1) // 2 or size[f"{c}_until"] <= rows[c] // 2:  # the bounds have missed the middle
            below[c], inside = 0, F.lit(True)
        pairs.append(F.struct(F.lit(c).alias("name"), F.when(inside, known[c]).alias("value")))
    if not pairs:
        return table.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in numeric])
    counts = table.select(F.inline(F.array(*pairs))).where("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    walked = state_before(placed(counts, [F.asc("name"), F.asc("value")], label="medians"), ["name"], sums={"between": F.col("n")})
    of = lambda sizes: F.create_map(*[F.lit(v) for pair in sizes.items() for v in pair])[F.col("name")]
    walked = walked.withColumns({"before": F.col("between") + of(below), "rows": of(rows)})
    rank = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    low, high = F.floor((F.col("rows") - 1) / 2), F.floor(F.col("rows") / 2)
    middle = walked.groupBy("name").agg(
        ((F.max(F.when(rank(low), F.col("value"))) + F.max(F.when(rank(high), F.col("value")))) / 2).alias("median"))
    return middle.agg(*[F.coalesce(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(0.0)).alias(c) for c in numeric])


def prepare(table: DataFrame, categorical: list[str], numeric: list[str]) -> PipelineModel:
    """Fit ``preparation`` with exact medians: the imputer learns the mean of one row, which holds them."""
    imputer, *rest = preparation(categorical, numeric).getStages()
    with shuffles_released(table.sparkSession):
        imputer = imputer.fit(medians(table, numeric))
        return PipelineModel([imputer, *Pipeline(stages=rest).fit(imputer.transform(table)).stages])


def preparation(categorical: list[str], numeric: list[str]) -> Pipeline:
    """Impute and standardise numbers, one-hot categories (an unknown one is all zeros); fitted by ``prepare``."""
    filled = [f"{c}_filled" for c in numeric]
    index = [f"{c}_index" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=numeric, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(withMean=True, withStd=True, inputCol="numbers", outputCol="scaled"),
        StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=["scaled", *hot], outputCol="features"),
    ])


# ---------------------------------------------------------------- learners


@dataclass(frozen=True)
class Sizes:
    """How large the ensembles are; the defaults are the full models.  ``fits`` run at the same time."""

    trees: int = 300
    rounds: int = 300
    seed: int = 42
    fits: int = 8


def side_by_side(spark: SparkSession, calls: list[Callable], fits: int) -> list:
    """Results of independent fits, a few at a time: each is many small jobs that leave most of a cluster idle."""
    with ThreadPoolExecutor(max(1, fits)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, inheritable_thread_target(spark)(c)) for c in calls]]


def _classifiers(s: Sizes) -> dict:
    return {
        "rf": Trees("forest", s.trees, depth=8, least=10, classifies=True, seed=s.seed),
        "gb": Trees("boosted", s.rounds, depth=5, least=15, columns="all", classifies=True, seed=s.seed),
        "et": Trees("extra", s.trees, depth=8, least=10, classifies=True, seed=s.seed),
    }


def _regressors(s: Sizes) -> dict:
    return {
        "rf": Trees("forest", s.trees, depth=10, least=8, seed=s.seed),
        "gb": Trees("boosted", s.rounds, depth=6, least=12, columns="all", seed=s.seed),
        "et": Trees("extra", s.trees, depth=10, least=8, columns="all", seed=s.seed),
    }


@dataclass(frozen=True)
class Spec:
    """What tells the two models apart."""

    name: str
    categorical: list[str]
    numeric: list[str]
    learners: Callable[[Sizes], dict]
    folds: Callable[[DataFrame, int], DataFrame]
    classifies: bool


WINNER = Spec("winner", training.WINNER_CATEGORICAL, training.WINNER_NUMERIC, _classifiers,
              training.stratified_folds, True)
SCORE = Spec("score", training.SCORE_CATEGORICAL, training.SCORE_NUMERIC, _regressors,
             training.contiguous_folds, False)
_SPECS = {s.name: s for s in (WINNER, SCORE)}
def _score_with(model, df: DataFrame, name: str, classifies: bool) -> DataFrame:
    """Add ``base_<name>``: the probability of class 1, or the predicted value."""
    if not classifies:
        return model.setPredictionCol(f"base_{name}").transform(df)
    raw, prob, pred = f"{name}_raw", f"{name}_prob", f"{name}_pred"
    model.setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
    out = model.transform(df).withColumn(f"base_{name}", vector_to_array(prob)[1])
    return out.drop(raw, prob, pred)


@dataclass
class StackedModel:
    """Preparation, the trees of the base models as a table (``trees.TREE_SCHEMA``), how they were grown, and the linear model above."""

    spec: Spec
    prepare: PipelineModel
    bases: dict = field(default_factory=dict)
    trees: DataFrame | None = None
    meta: object = None

    def base_predictions(self, table: DataFrame) -> DataFrame:
        """Add ``base_<name>`` of every base model: batches of rows walk its trees (``trees.leaf_sums``)."""
        spec = self.spec
        # Hundreds of trees a row: rows of a few small files are dealt to all cores first.
        table = table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism)
        df = self.prepare.transform(as_inputs(table, spec.categorical, spec.numeric)).withColumn("_x", vector_to_array("features"))
        df = df.withColumn("_sums", trees.leaf_sums(F.col("_x"), self.trees, self.bases))
        return df.withColumns({f"base_{name}": trees.value_of(F.col("_sums")[k], how) for k, (name, how) in enumerate(self.bases.items())}).drop("_x", "_sums")

    def transform(self, table: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for the winner, ``probability`` of class 1."""
        spec = self.spec
        df = _base_vector(self.bases).transform(self.base_predictions(table))
        if spec.classifies:
            df = self.meta.setProbabilityCol("_p").setRawPredictionCol("_r").transform(df)
            df = df.withColumn("probability", vector_to_array("_p")[1])
        else:
            df = self.meta.transform(df)
        extra = ["prediction", "probability"] if spec.classifies else ["prediction"]
        return df.select(*table.columns, *extra)

    def save(self, path: str) -> None:
        """Write preparation and meta model with Spark ML persistence, the trees and how they were grown as tables, under one folder."""
        spark = self.trees.sparkSession
        self.prepare.write().overwrite().save(f"{path}/prepare")
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        rows = [(name, k, *(getattr(how, f) for f in _GROWN)) for k, (name, how) in enumerate(self.bases.items())]
        spark.createDataFrame(rows, _GROWN_SCHEMA).write.mode("overwrite").parquet(f"{path}/grown")
        self.meta.write().overwrite().save(f"{path}/meta")

    @staticmethod
    def load(name: str, path: str) -> StackedModel:
        spec, spark = _SPECS[name], SparkSession.active()
        meta = LogisticRegressionModel if spec.classifies else LinearRegressionModel
        grown = spark.read.schema(_GROWN_SCHEMA).parquet(f"{path}/grown").orderBy("place").collect()  # a row per base model
        return StackedModel(
            spec, PipelineModel.load(f"{path}/prepare"), {r.learner: Trees(*(r[f] for f in _GROWN)) for r in grown},
            spark.read.schema(trees.TREE_SCHEMA).parquet(f"{path}/trees"), meta.load(f"{path}/meta"),
        )

    def importances(self, df: DataFrame, top: int | None = None) -> DataFrame:
        """(feature, importance) of the forest by the gains of its splits, named from the prepared column's metadata."""
        spec, spark = self.spec, df.sparkSession
        prepared = self.prepare.transform(as_inputs(df, spec.categorical, spec.numeric))
        attrs = prepared.schema["features"].metadata["ml_attr"]["attrs"]
        names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
        # The scaled block carries positions only; its order is that of the numeric inputs.
        names.update(enumerate(spec.numeric))
        names = spark.createDataFrame([(i, n.replace("_hot_", "_")) for i, n in names.items()], "position int, feature string")
        weights = trees.importances(self.trees.where("learner = 'rf'")).withColumnRenamed("feature", "position")
        out = names.join(weights, "position", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
        out = out.orderBy(F.desc("importance"), "feature")
        return out.limit(top) if top else out


_GROWN = ("kind", "trees", "depth", "least", "columns", "classifies", "rate", "most_leaves", "seed")
_GROWN_SCHEMA = ("learner string, place int, kind string, trees int, depth int, least int, columns string, classifies boolean, "
                 "rate double, most_leaves int, seed int")


def _base_vector(bases) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"base_{n}" for n in bases], outputCol="base_vector")


def fit_base(spec: Spec, train: DataFrame, name: str = "rf", sizes: Sizes = Sizes()) -> StackedModel:
    """Preparation and one base model alone, enough for ``importances``; the same as in the full model."""
    inputs = as_inputs(train, spec.categorical, spec.numeric)
    prepared = prepare(inputs, spec.categorical, spec.numeric)
    table = Table.of(prepared.transform(inputs).withColumn("fold", F.lit(0)), f"{spec.name}-prepared")
    how = spec.learners(sizes)[name]
    return StackedModel(spec, prepared, {name: how}, trees.grow([table], how, name, 0, only_whole=True)[0])


def fit(spec: Spec, train: DataFrame, sizes: Sizes = Sizes(), folds: int = FOLDS) -> StackedModel:
    """Fit preparation, out-of-fold base predictions, the model above, and the final bases.

    The fits without a fold and the final ones are grown together; the prepared rows are written once.
    """
    inputs = as_inputs(train, spec.categorical, spec.numeric)
    prepared = prepare(inputs, spec.categorical, spec.numeric)
    table = Table.of(prepared.transform(spec.folds(inputs, folds)), f"{spec.name}-prepared")
    learners = spec.learners(sizes)
    grown, rows = _grown([table], learners, sizes, folds)
    meta = fit_meta(rows, list(learners), spec.classifies)
    return StackedModel(spec, prepared, learners, grown.where("fold = -1"), meta)


def _grown(tables: list[Table], learners: dict, sizes: Sizes, folds: int, trees_of: list[int] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """The trees of all learners, and set, id, label, fold with ``base_<name>`` by the fit that has not seen the row."""
    spark = tables[0].rows.sparkSession
    first = sorted(learners, key=lambda name: learners[name].kind != "boosted")  # tasks that cannot be shortened
    calls = [partial(trees.grow, tables, learners[name], name, folds, trees_of=trees_of) for name in first]
    made = dict(zip(first, side_by_side(spark, calls, sizes.fits), strict=True))
    rows, grown = None, None
    for name, (model, values) in ((name, made[name]) for name in learners):
        values = values.withColumnRenamed("value", f"base_{name}")
        rows = values if rows is None else rows.join(values.drop("label", "fold"), ["set", "id"])
        grown = model if grown is None or model is None else grown.unionByName(model)
    return grown, written(rows, "out-of-fold")


def fit_meta(rows: DataFrame, bases: list[str], classifies: bool):
    """The linear model above: logistic or ridge regression with a penalty of 1 on ``base_<name>`` columns and ``label``.

    Linear regression scales the label to deviation 1 before it adds the penalty, so the penalty is given in deviations.
    """
    n, deviation = rows.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    common = dict(featuresCol="base_vector", labelCol="label", elasticNetParam=0.0,
                  regParam=1.0 / n if classifies else (deviation or 1.0) / n, standardization=False, maxIter=1000, tol=1e-10)
    return (LogisticRegression(**common) if classifies else LinearRegression(**common)).fit(_base_vector(bases).transform(rows))


def out_of_fold(spec: Spec, ready: DataFrame, sizes: Sizes, folds: int = FOLDS) -> DataFrame:
    """Base predictions for every row by models that have not seen its fold; learners are ``Trees`` or Spark ML estimators."""
    learners = spec.learners(sizes)
    if all(isinstance(e, Trees) for e in learners.values()):
        return _grown([Table.of(ready, f"{spec.name}-ready")], learners, sizes, folds, [])[1].drop("set", "id")
    todo = [(i, name, learner) for i in range(folds) for name, learner in learners.items()]
    calls = [partial(e.fit, ready.filter(F.col("fold") != i)) for i, _, e in todo]
    models = side_by_side(ready.sparkSession, calls, sizes.fits)
    parts = None
    for i in range(folds):
        held = ready.filter(F.col("fold") == i)
        for (k, name, _), model in zip(todo, models, strict=True):
            held = _score_with(model, held, name, spec.classifies) if k == i else held
        part = held.drop("features")
        parts = part if parts is None else parts.unionByName(part)
    return written(parts, f"{spec.name}-out-of-fold")


def _without(spec: Spec, numbered: DataFrame, i: int, folds: int) -> Table:
    """The rows outside fold ``i`` with preparation and inner folds of their own; those of fold ``i`` as rows that no fit may see."""
    inside = as_inputs(numbered.filter(F.col("fold") != i).drop("fold"), spec.categorical, spec.numeric)
    prepared = prepare(inside, spec.categorical, spec.numeric)
    held = as_inputs(numbered.filter(F.col("fold") == i), spec.categorical, spec.numeric).withColumn("fold", F.lit(-1))
    parts = [prepared.transform(p).select("label", "features", "fold") for p in (spec.folds(inside, folds), held)]
    return Table.of(parts[0].unionByName(parts[1]), f"{spec.name}-without-{i}")


def _scores(spec: Spec, rows: DataFrame, learners: dict, sizes: Sizes, folds: int) -> DataFrame:
    """(fold, score) of the held-out rows of sets 0 to ``folds`` - 1, each with a linear model of its own above."""
    def score(i: int) -> DataFrame:
        own = rows.where(F.col("set") == i)
        meta = fit_meta(own.where("fold >= 0"), list(learners), spec.classifies)
        held = meta.transform(_base_vector(learners).transform(own.where("fold = -1")))
        hit = F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)
        value = hit if spec.classifies else F.abs(F.col("label") - F.col("prediction"))
        return held.agg(F.lit(i).alias("fold"), F.avg(value).alias("score"))

    parts = None
    for part in side_by_side(rows.sparkSession, [partial(score, i) for i in range(folds)], sizes.fits):
        parts = part if parts is None else parts.unionByName(part)
    return parts


def cross_validate(spec: Spec, train: DataFrame, sizes: Sizes = Sizes(), folds: int = FOLDS) -> DataFrame:
    """(fold, score): accuracy of the winner model, mean absolute error of the score model.

    Preparation, inner folds and model above are those of each fold's own training rows; the trees of all folds and all
    inner folds are grown in the same passes.
    """
    numbered = written(spec.folds(train, folds), f"{spec.name}-outer")
    tables = side_by_side(train.sparkSession, [partial(_without, spec, numbered, i, folds) for i in range(folds)], sizes.fits)
    learners = spec.learners(sizes)
    return _scores(spec, _grown(tables, learners, sizes, folds, [])[1], learners, sizes, folds)


def fit_and_validate(spec: Spec, train: DataFrame, sizes: Sizes = Sizes(), folds: int = FOLDS) -> tuple[StackedModel, DataFrame]:
    """What ``fit`` and ``cross_validate`` give, all trees of both grown in the same passes."""
    numbered = written(spec.folds(train, folds), f"{spec.name}-outer")

    def whole() -> tuple[PipelineModel, Table]:
        inputs = as_inputs(train, spec.categorical, spec.numeric)
        prepared = prepare(inputs, spec.categorical, spec.numeric)
        return prepared, Table.of(prepared.transform(spec.folds(inputs, folds)), f"{spec.name}-prepared")

    *tables, (prepared, table) = side_by_side(
        train.sparkSession, [*[partial(_without, spec, numbered, i, folds) for i in range(folds)], whole], sizes.fits)
    learners = spec.learners(sizes)
    grown, rows = _grown([*tables, table], learners, sizes, folds, [folds])
    meta = fit_meta(rows.where(F.col("set") == folds), list(learners), spec.classifies)
    return StackedModel(spec, prepared, learners, grown.where("fold = -1"), meta), _scores(spec, rows, learners, sizes, folds)


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))
