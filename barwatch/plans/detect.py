"""From prices to scored and flagged rows, for each of the four models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.functions.checks import check_model, parse_threshold
from barwatch.operators import score as sc
from barwatch.operators.features import engineer_features
from barwatch.operators.models import gmm, iforest, kmeans, ocsvm
from barwatch.operators.stats import feature_space, in_space, selected_names
from barwatch.schema import INDICATORS, OHLCV, SYMBOL
from barwatch.session import join_parameters, materialize

RESULT = [
    SYMBOL, *OHLCV, *INDICATORS, "features", "cluster", "distance", "threshold", "is_anomaly", "model_used",
]

_MODELS = {"kmeans": kmeans, "gmm": gmm, "isolation_forest": iforest, "svm": ocsvm}


@dataclass(frozen=True)
class Model:
    """A fitted model as tables: the feature space of each symbol, parameters and thresholds of each group.

    ``params`` has ``centres`` (kmeans), ``weights`` and ``means`` with whitening matrices (gmm), trees
    (isolation_forest) or weights of Fourier features (svm); with ``by`` it and ``thresholds`` have a row or more for each symbol.
    """

    model: str
    by: str | None
    space: DataFrame
    params: DataFrame
    thresholds: DataFrame

    def centres(self) -> DataFrame:
        """One row per group and cluster: ``cluster`` and ``centre``, in the model's own columns."""
        group = [self.by] if self.by else []
        if self.model == "kmeans":
            lists = self.params.select(*group, F.col("centres"))
        elif self.model == "gmm":
            width = F.size("means") / F.size("logs")
            cut = F.transform(F.sequence(F.lit(0), F.size("logs") - 1), lambda i: F.slice("means", (i * width + 1).cast("int"), width.cast("int")))
            lists = self.params.select(*group, cut.alias("centres"))
        else:
            raise ValueError(f"{self.model} has no centres")
        return lists.select(*group, F.posexplode("centres").alias("cluster", "centre"))

    def columns(self) -> DataFrame:
        """``symbol`` and the names of the features that its model reads."""
        return self.space.select(SYMBOL, selected_names(F.col("keep")).alias("columns"))

    def write(self, path: str) -> None:
        """The tables and, last, the row that names the model: a folder without it is no model."""
        for name in ("space", "params", "thresholds"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        named = self.space.sparkSession.createDataFrame([(self.model, self.by)], "model string, by string")
        named.write.parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> Model:
    model, by = spark.read.parquet(f"{path}/model").first()
    return Model(model, by, *[spark.read.parquet(f"{path}/{name}") for name in ("space", "params", "thresholds")])


def detect_anomalies(
    prices: DataFrame, model: str = "kmeans", k_sigma: float = sc.DEFAULT_SIGMAS, by: str | None = None, **layout
) -> DataFrame:
    """Score every complete row of ``prices`` and flag the unusual ones.

    ``by=None`` fits one model over all rows; ``by="symbol"`` gives each
    symbol its own columns, model and threshold.  KMeans and the mixture flag
    scores above mean plus ``k_sigma`` deviations; the other two flag the top
    5 %.  All models return the same columns.
    """
    return fit_and_score(prices, model, k_sigma, by, **layout)[1]


def fit_and_score(
    prices: DataFrame, model: str = "kmeans", k_sigma: float = sc.DEFAULT_SIGMAS, by: str | None = None, **layout
) -> tuple[Model | None, DataFrame]:
    """The fitted model, to be written or to score other rows, and the rows of :func:`detect_anomalies`; None without complete rows."""
    check_model(model)
    if by not in (None, SYMBOL):
        raise ValueError("by must be None or 'symbol'")
    featured = materialize(engineer_features(prices, keep_position=True, **layout), "featured")
    return fit_features(featured, model, k_sigma, by)


def fit_features(
    featured: DataFrame, model: str, k_sigma: float = sc.DEFAULT_SIGMAS, by: str | None = None
) -> tuple[Model | None, DataFrame]:
    """The model half of :func:`fit_and_score`, on a table of features with positions."""
    k_sigma = parse_threshold(k_sigma)
    adaptive = check_model(model) in ("kmeans", "gmm")
    group = [by] if by else []
    if featured.isEmpty():
        return None, _no_rows(featured, model)
    space = feature_space(featured, by, ddof=1 if adaptive else 0)
    rows = in_space(featured, space)
    points = rows.select(SYMBOL, "_pos", "features", "group_rows").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        params = _MODELS[model].fit(points, by)
    finally:
        points.unpersist()
    # Written once: the threshold and every reader share one scoring pass.
    scored = materialize(_scored(rows, model, params, by), "scored")
    thresholds = sc.adaptive_threshold(scored, group, k_sigma) if adaptive else sc.contamination_cut(scored, group)
    fitted = Model(model, by, space, params, materialize(thresholds, "thresholds"))
    return fitted, _flagged(scored, fitted)


def score_with(prices: DataFrame, fitted: Model, **layout) -> DataFrame:
    """Other prices under a fitted model: its columns, scales, parameters and thresholds, none of them taken anew.

    Rows of symbols that the model has not seen are left out.
    """
    featured = materialize(engineer_features(prices, keep_position=True, **layout), "featured")
    return score_features(featured, fitted)


def score_features(featured: DataFrame, fitted: Model) -> DataFrame:
    """The model half of :func:`score_with`."""
    rows = in_space(featured, fitted.space)
    # Rows are dealt over tasks by how many there are now, not by how many the model was fitted on.
    counts = featured.groupBy(SYMBOL).agg(F.count(F.lit(1)).alias("group_rows"))
    rows = join_parameters(rows.drop("group_rows"), counts, [SYMBOL])
    return _flagged(_scored(rows, fitted.model, fitted.params, fitted.by), fitted)


def _scored(rows: DataFrame, model: str, params: DataFrame, by: str | None) -> DataFrame:
    scored = _MODELS[model].score(rows, params, by)
    return scored if "cluster" in scored.columns else scored.withColumn("cluster", F.lit(None).cast("int"))


def _flagged(scored: DataFrame, fitted: Model) -> DataFrame:
    flagged = sc.flag(scored, fitted.thresholds, [fitted.by] if fitted.by else [])
    return flagged.withColumn("model_used", F.lit(fitted.model)).select(*RESULT)


def _no_rows(featured: DataFrame, model: str) -> DataFrame:
    return featured.selectExpr(
        "*",
        "cast(null as array<double>) as features",
        "cast(null as int) as cluster",
        "cast(null as double) as distance",
        "cast(null as double) as threshold",
        "cast(null as int) as is_anomaly",
        f"'{model}' as model_used",
    ).select(*RESULT)
