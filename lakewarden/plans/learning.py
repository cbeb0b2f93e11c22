"""Features, labels, model training and scoring, and model governance metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import (
    DRIFT_FEATURES, LABEL_SEVERITY, MODEL_CATEGORICAL, MODEL_NUMERIC, OTHER_SEVERITY,
    PLANTED_PREFIXES, SURROGATE_SEVERITY,
)
from lakewarden.functions.scoring import MODEL_WEIGHT, RULES_WEIGHT, blend_ai_risk, clamp, lookup
from lakewarden.operators.ranking import row_index, running_totals


def alert_features(cases: DataFrame, c360: DataFrame) -> DataFrame:
    """Case attributes plus 360 rollups with defaults; the planted flag is a label seed."""
    rollups = {"num_accounts": 0, "total_balance": 0.0, "current_risk_rating": 3, "recent_alerts": 0}
    planted = F.lit(False)
    for prefix in PLANTED_PREFIXES:
        planted = planted | F.col("customer_id").startswith(prefix)
    return cases.join(c360.select("customer_id", *rollups), "customer_id", "left").select(
        "case_id", "scenario", "priority",
        F.col("risk_score").cast("double").alias("risk_score"),
        F.col("amount").cast("double").alias("amount"),
        F.log10(F.greatest("amount", F.lit(1.0))).alias("amount_log"),
        F.col("days_open").cast("double").alias("days_open"),
        F.col("investigation_hours").cast("double").alias("investigation_hours"),
        *[F.coalesce(c, F.lit(d)).alias(c) for c, d in rollups.items()],
        F.when(planted, 1).otherwise(0).alias("is_planted_fraud"),
    )


def _amount_norm() -> Column:
    """About 0 at 300 thousand and 1 at 12 million (fixed values)."""
    return clamp((F.col("amount_log") - 5.5) / 1.6)


def _context() -> tuple[Column, Column]:
    return (
        F.least(F.lit(1.0), F.col("recent_alerts") / 4.0),
        F.greatest(F.lit(0.0), (F.col("current_risk_rating") - 3) / 2.0),
    )


def hash_bucket(c: str, n: int) -> Column:
    return F.pmod(F.hash(c), F.lit(n))


def sar_labels(features: DataFrame, noise: Column | None = None) -> DataFrame:
    """Label 1 for planted fraud, otherwise when the noise stays below the propensity."""
    noise = hash_bucket("case_id", 1000) / 1000.0 if noise is None else noise
    severity = lookup(F.col("scenario"), LABEL_SEVERITY, OTHER_SEVERITY)
    recent, band = _context()
    p = clamp(0.62 * (severity * _amount_norm()) + 0.18 * severity + 0.10 * recent + 0.10 * band)
    filed = (F.col("is_planted_fraud") == 1) | (noise < p)
    return features.select(
        "case_id", "is_planted_fraud", F.round(p, 4).alias("propensity"),
        F.when(filed, 1).otherwise(0).alias("sar_filed"),
    )


def surrogate_scores(features: DataFrame, version: str = "sql_blend_v1") -> DataFrame:
    """Deterministic stand-in for the trained model."""
    severity = lookup(F.col("scenario"), SURROGATE_SEVERITY, OTHER_SEVERITY)
    recent, band = _context()
    model = clamp(
        0.55 * F.col("is_planted_fraud") + 0.22 * (severity * _amount_norm())
        + 0.10 * severity + 0.08 * recent + 0.05 * band
    )
    shown = F.when(F.col("is_planted_fraud") == 1, F.greatest(model, F.lit(0.85))).otherwise(model)
    return features.select(
        "case_id",
        F.round(model, 4).alias("model_score"),
        F.round(F.col("risk_score") / 100.0, 4).alias("rules_score"),
        F.round(shown * 100, 1).alias("ai_risk"),
        F.lit(version).alias("model_version"),
    )


# -- trained model -------------------------------------------------------------


def split_labelled(
    features: DataFrame, labels: DataFrame, train_share: int = 70, label: str = "sar_filed"
) -> tuple[DataFrame, DataFrame]:
    """Reproducible 70/30 split: a hash within each class keeps the classes' shares."""
    data = features.join(labels.select("case_id", label), "case_id")
    bucket = F.pmod(F.xxhash64("case_id", label), F.lit(100))
    return data.filter(bucket < train_share), data.filter(bucket >= train_share)


def train_sar_model(
    train: DataFrame, label: str = "sar_filed", trees: int = 200, depth: int = 3,
    step: float = 0.05, seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees on the cluster: one-hot categories plus numerics."""
    indexed = [f"{c}_ix" for c in MODEL_CATEGORICAL]
    coded = [f"{c}_oh" for c in MODEL_CATEGORICAL]
    stages = [
        StringIndexer(inputCols=MODEL_CATEGORICAL, outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="keep"),
        VectorAssembler(inputCols=[*MODEL_NUMERIC, *coded], outputCol="features",
                        handleInvalid="keep"),
        GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth,
                      stepSize=step, seed=seed),
    ]
    return Pipeline(stages=stages).fit(train)


def score_cases(model: PipelineModel, features: DataFrame, version: str = "1") -> DataFrame:
    """Probability, rules score and blended 0-100 risk of every case."""
    p = vector_to_array("probability")[1]
    rules = clamp(F.col("risk_score") / 100.0)
    return model.transform(features).select(
        "case_id",
        F.round(p, 4).alias("model_score"),
        F.round(rules, 4).alias("rules_score"),
        blend_ai_risk(p, rules).alias("ai_risk"),
        F.lit(version).alias("model_version"),
    )


# -- validation ----------------------------------------------------------------


def auc(df: DataFrame, score: str, label: str, ties: str = "min") -> DataFrame:
    """ROC-AUC from the rank statistic, without a global window.

    Rows collapse to one per score; ranks follow from running totals over
    range-partitioned scores. ``ties`` picks the smallest or the middle rank.
    """
    by_score = df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n")
    )
    ranked = running_totals(by_score, score, ["n"])
    rank = F.col("n_before") + 1
    if ties == "mid":
        rank = rank + (F.col("n") - 1) / 2.0
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(
        ((F.sum(F.col("pos") * rank) - pos * (pos + 1) / 2.0) / F.nullif(pos * neg, F.lit(0))).alias("roc_auc")
    )


def score_cuts(grid: DataFrame, columns: list[str], share: float = 0.75) -> dict[str, float]:
    """Exact percentiles of discrete scores from (scores, count ``n``) rows.

    The scores are 0-100 with at most one decimal, so an aggregate holds at most
    1,001 values per column whatever the row count.
    """
    cuts = [F.percentile(F.col(c).cast("double"), F.lit(share), F.col("n")).alias(c) for c in columns]
    return grid.agg(*cuts).first().asDict()


def model_metrics(
    scores: DataFrame, features: DataFrame, labels: DataFrame, version: str = "sql_blend_v1",
    ties: str = "min",
) -> DataFrame:
    """Validation record: AUC and an equal-budget comparison at the upper quartile."""
    j = (
        scores.select("case_id", "model_score", "ai_risk")
        .join(features.select("case_id", "risk_score"), "case_id")
        .join(labels.select("case_id", "sar_filed"), "case_id")
    )
    grid = j.groupBy("ai_risk", "risk_score", "sar_filed").agg(F.count("*").alias("n"))
    cuts = score_cuts(grid, ["ai_risk", "risk_score"])
    pos = F.col("sar_filed") == 1
    flagged, ruled = (F.col(c) >= F.lit(cut) for c, cut in cuts.items())

    def n(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    conf = grid.agg(
        F.sum("n").alias("n_labelled"),
        n(pos).alias("positives"),
        n(flagged & pos).alias("model_tp"),
        n(flagged & ~pos).alias("model_fp"),
        n(~flagged & pos).alias("model_fn"),
        n(ruled & ~pos).alias("rules_fp"),
    )
    tp, fp, fn, rfp = (F.col(c) for c in ("model_tp", "model_fp", "model_fn", "rules_fp"))

    def ratio(a: Column, b: Column) -> Column:
        return a / F.nullif(b, F.lit(0))

    area = auc(j, "model_score", "sar_filed", ties).first()[0]
    return conf.select(
        F.lit("sar_propensity_gbt").alias("model_name"),
        F.lit(version).alias("model_version"),
        F.round(F.lit(area).cast("double"), 3).alias("roc_auc"),
        F.round(ratio(tp, tp + fp), 3).alias("precision"),
        F.round(ratio(tp, tp + fn), 3).alias("recall"),
        F.round(ratio(2.0 * tp, (2 * tp + fp + fn)), 3).alias("f1"),
        fp.cast("int").alias("model_fp"),
        rfp.cast("int").alias("rules_fp"),
        F.round(ratio(rfp - fp, rfp) * 100, 1).alias("fp_reduction_pct"),
        F.lit(len(MODEL_NUMERIC) + len(MODEL_CATEGORICAL)).alias("n_features"),
        F.col("n_labelled").cast("int").alias("n_labelled"),
        F.round(F.col("positives") / F.col("n_labelled"), 4).alias("positive_rate"),
        F.lit(MODEL_WEIGHT).alias("blend_model_weight"),
        F.lit(RULES_WEIGHT).alias("blend_rules_weight"),
        F.lit("validated").alias("governance_status"),
    )


def budget_fp(df: DataFrame, score: str, label: str, key: str, k: int | None = None) -> DataFrame:
    """False positives among the top ``k`` rows by score; ``k`` defaults to the positives.

    The cut is found on (score, count) rows, so no sort of all rows is needed;
    only rows tied at the cut are ordered by key.
    """
    if k is None:
        k = df.agg(F.count_if(F.col(label) == 1)).first()[0]
    by_score = df.groupBy((-F.col(score)).alias("_neg")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("fp")
    )
    ranked = running_totals(by_score, "_neg", ["n"])
    room = F.lit(k) - F.col("n_before")
    full = ranked.filter(room >= F.col("n")).agg(F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"))
    edge = ranked.filter((room > 0) & (room < F.col("n"))).select("_neg", room.alias("take")).first()
    part = 0
    if edge is not None:
        tied = row_index(df.filter(F.col(score) == -edge["_neg"]).select(key, label), [key], "_pos")
        part = tied.filter(F.col("_pos") <= edge["take"]).agg(F.count_if(F.col(label) == 0)).first()[0]
    return full.select(
        F.lit(score).alias("ranking"), F.lit(int(k)).cast("bigint").alias("budget"),
        (F.col("fp") + part).cast("bigint").alias("false_positives"),
    )


# -- drift ---------------------------------------------------------------------


def feature_profile(features: DataFrame, prefix: str, columns=DRIFT_FEATURES) -> DataFrame:
    """Mean, deviation and null rate per feature: one wide aggregate, then unpivoted."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(v).alias(f"{prefix}_mean"),
                F.coalesce(F.stddev(v), F.lit(0.0)).alias(f"{prefix}_std"),
                F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias(f"{prefix}_null_rate"),
            ).alias(c)
        )
    wide = features.agg(*aggs)
    return wide.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def train_slice(bucket: Column | None = None) -> Column:
    """The deterministic 70 % slice the model was trained on."""
    return (hash_bucket("case_id", 10) if bucket is None else bucket) < 7


def feature_baseline(features: DataFrame, bucket: Column | None = None) -> DataFrame:
    return feature_profile(features.filter(train_slice(bucket)), "baseline")


def feature_current(features: DataFrame, bucket: Column | None = None) -> DataFrame:
    return feature_profile(features.filter(~train_slice(bucket)), "current")


def drift_metrics(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Standardised mean shift per feature with its status."""
    shift = F.abs(F.col("current_mean") - F.col("baseline_mean")) / F.nullif(
        F.col("baseline_std"), F.lit(0.0)
    )
    return baseline.join(current, "feature").select(
        "feature",
        F.round("baseline_mean", 3).alias("baseline_mean"),
        F.round("current_mean", 3).alias("current_mean"),
        F.round(shift, 3).alias("mean_shift_sigma"),
        F.when(shift >= 0.5, "drift").when(shift >= 0.2, "warning").otherwise("stable").alias(
            "drift_status"
        ),
    )


def drift_verdict(drift: DataFrame) -> DataFrame:
    """Worst status over all features."""
    rank = lookup(F.col("drift_status"), {"drift": 2, "warning": 1}, 0)
    names = F.array(*[F.lit(s) for s in ("stable", "warning", "drift")])
    worst = F.coalesce(F.max(rank), F.lit(0))
    return drift.agg(F.element_at(names, worst + 1).alias("overall_status"))


def latest_metrics(records: DataFrame, version: str = "model_version") -> DataFrame:
    """Newest governance record; versions compare as numbers, others come last."""
    number = F.col(version).try_cast("bigint")
    return records.orderBy(number.desc_nulls_last(), F.desc(version)).limit(1)
