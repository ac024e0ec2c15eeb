"""Metric queries over the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.catalog.registry import LABELS, SQL_JUDGED, judged, query, rounded, table
from labelloom.operators.folds import assign_folds
from labelloom.operators.metrics import (
    balanced_weights,
    confusion,
    elementwise_accuracy,
    f1_report,
    macro_harmonic,
    macro_mean_f1,
    metric_bundle,
    positive_weights,
    precision_recall_f1,
)
from labelloom.catalog.registry import sql_order

RATIOS = ("accuracy", "precision", "recall", "f1")


def sql_scored(*group: str) -> str:
    """CTEs from ``cells`` to counts and scores per label (and group)."""
    g = "".join(f"{c}, " for c in group)
    return f"""counts AS (
      SELECT {g}label, count(*) FILTER (WHERE t = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE t <> 1 AND p = 1) AS fp,
             count(*) FILTER (WHERE t = 1 AND p <> 1) AS fn,
             count(*) FILTER (WHERE t <> 1 AND p <> 1) AS tn
      FROM cells GROUP BY {g}label
    ), ratios AS (
      SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall
      FROM counts
    ), scored AS (
      SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
                     ELSE 2 * precision * recall / (precision + recall) END AS f1
      FROM ratios
    )"""


SQL_MACRO = """avg(precision) AS p, avg(recall) AS r, avg(accuracy) AS a"""
SQL_MACRO_OUT = """round(p, 6) AS macro_precision, round(r, 6) AS macro_recall, round(a, 6) AS macro_accuracy,
  round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS macro_f1"""
MACRO = ("macro_precision", "macro_recall", "macro_accuracy", "macro_f1")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return precision_recall_f1(confusion(judged(spark, d), LABELS))


@query("label_confusion", f"WITH {SQL_JUDGED}, {sql_scored()} SELECT label, tp, fp, fn, tn FROM counts")
def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return confusion(judged(spark, d), LABELS)


@query("label_confusion_long", f"WITH {SQL_JUDGED}, {sql_scored()} SELECT label, tp, fp, fn, tn FROM counts")
def label_confusion_long(spark: SparkSession, d: str) -> DataFrame:
    return confusion(judged(spark, d), LABELS, layout="long")


@query(
    "label_prf",
    f"""WITH {SQL_JUDGED}, {sql_scored()}
        SELECT label, tp, fp, fn, tn, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision,
               round(recall, 4) AS recall, round(f1, 4) AS f1 FROM scored""",
)
def label_prf(spark: SparkSession, d: str) -> DataFrame:
    return precision_recall_f1(confusion(judged(spark, d), LABELS), digits=4)


@query(
    "macro_prf_harmonic",
    f"WITH {SQL_JUDGED}, {sql_scored()}, m AS (SELECT {SQL_MACRO} FROM scored) SELECT {SQL_MACRO_OUT} FROM m",
)
def macro_prf(spark: SparkSession, d: str) -> DataFrame:
    return macro_harmonic(scored(spark, d)).select(*[rounded(c).alias(c) for c in MACRO])


def sql_mean_f1(digits: int) -> str:
    return f"""WITH {SQL_JUDGED}, {sql_scored()}
        SELECT round(avg(round(f1, {digits})), {digits}) AS avg_f1 FROM scored"""


@query("macro_f1_mean6", sql_mean_f1(6))
def macro_f1_mean6(spark: SparkSession, d: str) -> DataFrame:
    return macro_mean_f1(scored(spark, d), 6)


@query("macro_f1_mean2", sql_mean_f1(2))
def macro_f1_mean2(spark: SparkSession, d: str) -> DataFrame:
    return macro_mean_f1(scored(spark, d), 2)


@query(
    "f1_report",
    f"""WITH {SQL_JUDGED}, {sql_scored()}
        SELECT label, round(f1, 2) AS f1 FROM scored
        UNION ALL SELECT 'avg-f1-score', round(avg(round(f1, 2)), 2) FROM scored""",
)
def report(spark: SparkSession, d: str) -> DataFrame:
    return f1_report(scored(spark, d), 2)


@query(
    "elementwise_accuracy",
    f"""WITH {SQL_JUDGED}
        SELECT round(avg(((s > 0.5) = (t <> 0))::INTEGER), 6) AS accuracy_thresh FROM cells""",
)
def elementwise(spark: SparkSession, d: str) -> DataFrame:
    return elementwise_accuracy(judged(spark, d), LABELS).select(
        rounded("accuracy_thresh").alias("accuracy_thresh")
    )


@query(
    "elementwise_accuracy_logits",
    f"""WITH {SQL_JUDGED}
        SELECT round(avg(((1 / (1 + exp(-(8 * s - 4))) > 0.7) = (t <> 0))::INTEGER), 6) AS accuracy_thresh
        FROM cells""",
)
def elementwise_logits(spark: SparkSession, d: str) -> DataFrame:
    logits = judged(spark, d).select("t_quality", "t_toxic", F.col("x_quality").alias("s_quality"), F.col("x_toxic").alias("s_toxic"))
    return elementwise_accuracy(logits, LABELS, 0.7, as_logits=True).select(
        rounded("accuracy_thresh").alias("accuracy_thresh")
    )


SQL_BUNDLE = f"""WITH {SQL_JUDGED.replace("t_quality AS t, p_quality AS p", "t_quality AS t, (s_quality > 0.5)::INTEGER AS p")
                     .replace("t_toxic, p_toxic, s_toxic", "t_toxic, (s_toxic > 0.5)::INTEGER, s_toxic")},
     {sql_scored()}
     SELECT round((SELECT avg(((s > 0.5) = (t = 1))::INTEGER) FROM cells), 6) AS accuracy_thresh,
            max(round(f1, 6)) FILTER (WHERE label = 'quality') AS f1_quality,
            max(round(f1, 6)) FILTER (WHERE label = 'toxic') AS f1_toxic,
            round(avg(round(f1, 6)), 6) AS macro_avg_f1 FROM scored"""


@query("metric_bundle", SQL_BUNDLE)
def bundle(spark: SparkSession, d: str) -> DataFrame:
    return metric_bundle(judged(spark, d), LABELS).select(
        rounded("accuracy_thresh").alias("accuracy_thresh"),
        *[F.element_at("f1_score", F.lit(n)).alias(f"f1_{n}") for n in LABELS],
        "macro_avg_f1",
    )


@query(
    "pos_weight",
    """SELECT 'quality' AS label, round((count(*) - sum(quality)) / sum(quality), 6) AS pos_weight FROM labels
       UNION ALL SELECT 'toxic', round((count(*) - sum(toxic)) / sum(toxic), 6) FROM labels""",
)
def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    return positive_weights(table(spark, d, "labels"), LABELS).select("label", rounded("pos_weight").alias("pos_weight"))


@query(
    "balanced_weight",
    """WITH c AS (SELECT 'quality' AS label, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels)
       SELECT label, y, round((SELECT count(*) FROM labels) / (2 * count(*)), 6) AS weight
       FROM c GROUP BY label, y""",
)
def balanced(spark: SparkSession, d: str) -> DataFrame:
    return balanced_weights(table(spark, d, "labels"), LABELS).select("label", "y", rounded("weight").alias("weight"))


SQL_BY_FOLD = f"""{SQL_JUDGED.split(", cells AS")[0]}, folds AS (
  SELECT *, ntile(6) OVER (ORDER BY {sql_order('2', 'doc_id')}) AS fold FROM judged
), cells AS (
  SELECT fold, 'quality' AS label, t_quality AS t, p_quality AS p FROM folds
  UNION ALL SELECT fold, 'toxic', t_toxic, p_toxic FROM folds
)"""


@query(
    "cv_metrics",
    f"""WITH {SQL_BY_FOLD}, {sql_scored('fold')}, m AS (SELECT fold, {SQL_MACRO} FROM scored GROUP BY fold)
        SELECT fold::INTEGER AS fold, {SQL_MACRO_OUT} FROM m""",
)
def cv_metrics(spark: SparkSession, d: str) -> DataFrame:
    held = assign_folds(judged(spark, d), ["doc_id"])
    per_label = precision_recall_f1(confusion(held, LABELS, ["fold"]))
    return macro_harmonic(per_label, ["fold"]).select("fold", *[rounded(c).alias(c) for c in MACRO])


@query(
    "cv_label_f1",
    f"""WITH {SQL_BY_FOLD}, {sql_scored('fold')}
        SELECT fold::INTEGER AS fold, label, round(f1, 6) AS f1 FROM scored""",
)
def cv_label_f1(spark: SparkSession, d: str) -> DataFrame:
    held = assign_folds(judged(spark, d), ["doc_id"])
    per_label = precision_recall_f1(confusion(held, LABELS, ["fold"]), digits=6)
    return per_label.select("fold", "label", "f1")
