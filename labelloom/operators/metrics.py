"""Multi-label metrics. All of them start from one pass of counts per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.operators.columns import unpivot_labels

# One sum per counter and label; beyond this many labels the rows are unpivoted
# instead, because very wide aggregates fall out of generated code.
WIDE_LABELS = 20
COUNTERS = ("tp", "fp", "fn", "tn")


def _cases(truth: Column, guess: Column) -> list[Column]:
    actual = F.coalesce(truth == 1, F.lit(False))
    called = F.coalesce(guess == 1, F.lit(False))
    return [actual & called, ~actual & called, actual & ~called, ~actual & ~called]


def confusion(
    aligned: DataFrame,
    labels: Sequence[str],
    group: Sequence[str] = (),
    layout: str = "auto",
) -> DataFrame:
    """``(group…, label, tp, fp, fn, tn)`` from columns ``t_<label>`` and ``p_<label>``.

    A cell is positive when it equals 1; every other value counts as 0. Both layouts
    combine on the map side and shuffle only one small row per task and group, and give
    the same rows: without groups every label has one, with groups every group and label.
    """
    if layout == "auto":
        layout = "wide" if len(labels) <= WIDE_LABELS else "long"
    if layout == "wide":
        sums = [
            F.count_if(case).alias(f"{counter}_{i}")
            for i, name in enumerate(labels)
            for counter, case in zip(COUNTERS, _cases(F.col(f"`t_{name}`"), F.col(f"`p_{name}`")))
        ]
        rows = [
            F.struct(F.lit(name).alias("label"), *[F.col(f"{c}_{i}").alias(c) for c in COUNTERS])
            for i, name in enumerate(labels)
        ]
        return aligned.groupBy(*group).agg(*sums).select(*group, F.inline(F.array(*rows)))
    cells = [
        F.struct(
            F.lit(name).alias("label"),
            F.col(f"`t_{name}`").alias("t"),
            F.col(f"`p_{name}`").alias("p"),
        )
        for name in labels
    ]
    cases = [case & F.col("_real") for case in _cases(F.col("t"), F.col("p"))]
    rows = aligned.select(*group, F.inline(F.array(*cells))).withColumn("_real", F.lit(True))
    if not group:  # an empty table has its labels too
        spark = aligned.sparkSession
        names = spark.createDataFrame([(n,) for n in labels], "label string")
        nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("t", "p")]
        rows = rows.union(names.select("label", *nothing, F.lit(False)))
    return rows.groupBy(*group, "label").agg(
        *[F.count_if(case).alias(c) for c, case in zip(COUNTERS, cases)]
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def precision_recall_f1(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 beside the counts; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTERS)
    scored = (
        counts.withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
    )
    p, r = F.col("precision"), F.col("recall")
    scored = scored.withColumn("f1", _ratio(F.lit(2.0) * p * r, p + r))
    if digits is None:
        return scored
    return scored.withColumns(
        {c: F.round(F.col(c), digits) for c in ("accuracy", "precision", "recall", "f1")}
    )


def macro_harmonic(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Macro precision, recall and accuracy, and their F1.

    The F1 is the harmonic mean of macro precision and macro recall, not the mean of
    the F1s; it is 0 when both are 0.
    """
    means = scored.groupBy(*group).agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("accuracy").alias("macro_accuracy"),
    )
    p, r = F.col("macro_precision"), F.col("macro_recall")
    return means.withColumn("macro_f1", _ratio(F.lit(2.0) * p * r, p + r))


def macro_mean_f1(scored: DataFrame, digits: int, group: Sequence[str] = ()) -> DataFrame:
    """Mean of the F1s that were first rounded, rounded again to the same digits."""
    mean = F.avg(F.round(F.col("f1"), digits))
    return scored.groupBy(*group).agg(F.round(mean, digits).alias("avg_f1"))


def f1_report(scored: DataFrame, digits: int) -> DataFrame:
    """``(label, f1)`` per label plus the row ``avg-f1-score`` with their mean."""
    per_label = scored.select("label", F.round("f1", digits).alias("f1"))
    mean = macro_mean_f1(scored, digits).select(
        F.lit("avg-f1-score").alias("label"), F.col("avg_f1").alias("f1")
    )
    return per_label.unionByName(mean)


def elementwise_accuracy(
    scores: DataFrame,
    labels: Sequence[str],
    threshold: float = 0.5,
    group: Sequence[str] = (),
    as_logits: bool = False,
) -> DataFrame:
    """Share of cells in which ``score > threshold`` agrees with the label.

    Reads ``t_<label>`` and ``s_<label>``. A cell without a score or a label is no hit.
    One pass: the hits of a row are added up before the aggregation.
    """

    def hit(name: str) -> Column:
        score = F.col(f"`s_{name}`")
        if as_logits:
            score = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
        agrees = (score > threshold) == (F.col(f"`t_{name}`") != 0)
        return F.coalesce(agrees, F.lit(False)).cast("long")

    in_row = hit(labels[0])
    for name in labels[1:]:
        in_row = in_row + hit(name)
    return scores.groupBy(*group).agg(
        _ratio(F.sum(in_row), F.count(F.lit(1)) * len(labels)).alias("accuracy_thresh")
    )


def metric_bundle(scores: DataFrame, labels: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """One row: element-wise accuracy, the F1 of every label as a map, and their mean.

    Everything comes out of one confusion pass, because the hits are ``tp + tn``.
    """
    guesses = scores.select(
        *[F.col(f"`t_{n}`") for n in labels],
        *[(F.col(f"`s_{n}`") > threshold).cast("int").alias(f"p_{n}") for n in labels],
    )
    scored = precision_recall_f1(confusion(guesses, labels))
    cells = F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    rounded = F.round("f1", 6)
    return scored.agg(
        _ratio(F.sum(F.col("tp") + F.col("tn")), cells).alias("accuracy_thresh"),
        F.map_from_entries(F.collect_list(F.struct("label", rounded.alias("f1")))).alias("f1_score"),
        F.round(F.avg(rounded), 6).alias("macro_avg_f1"),
    )


def label_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, rows, positives)`` in one pass."""
    cells = unpivot_labels(df, labels, [])
    return cells.groupBy("label").agg(
        F.count("y").alias("rows"), F.sum(F.col("y").cast("long")).alias("positives")
    )


def positive_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, pos_weight)`` with ``(rows - positives) / positives``; null without positives."""
    weight = F.try_divide(
        (F.col("rows") - F.col("positives")).cast("double"), F.col("positives").cast("double")
    )
    return label_counts(df, labels).select("label", weight.alias("pos_weight"))


def balanced_weights(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, y, weight)`` with ``rows / (2 * rows of the class)``."""
    rows, positives = F.col("rows"), F.col("positives")
    classes = F.array(
        F.struct(F.lit(0).alias("y"), (rows - positives).alias("class_rows")),
        F.struct(F.lit(1).alias("y"), positives.alias("class_rows")),
    )
    spread = label_counts(df, labels).select("label", "rows", F.inline(classes))
    weight = F.col("rows").cast("double") / (F.lit(2.0) * F.col("class_rows"))
    return spread.filter("class_rows > 0").select("label", "y", weight.alias("weight"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row with the table's shape."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long")
    )
