"""Losses on small tables, worked out with numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions.losses import bce_with_logits
from labelloom.functions.vectors import log_softmax, masked_softmax, l2_normalize
from labelloom.operators.losses import (
    asymmetric_loss,
    bce_loss,
    contrastive_loss,
    label_overlap,
    single_label_loss,
)


def logits(spark):
    return spark.createDataFrame([(2.0, -30.0, 1, 0), (-1.0, 40.0, 0, 1)], "x_a double, x_b double, t_a int, t_b int")


def sigma(x):
    return 1 / (1 + np.exp(-x))


def test_bce_is_stable_and_weighted_by_name(spark):
    assert spark.range(1).select(bce_with_logits(F.lit(-800.0), F.lit(1.0))).first()[0] == pytest.approx(800.0)
    weights = spark.createDataFrame([("b", 5.0), ("a", 2.0), ("other", 9.0)], "label string, pos_weight double")
    found = bce_loss(logits(spark), ["a", "b"], weights).first()["bce"]
    expected = -(2 * np.log(sigma(2.0)) + np.log(1 - sigma(-1.0)) + 5 * np.log(sigma(40.0))) / 4
    assert found == pytest.approx(expected, abs=1e-9)
    lacking = weights.filter("label <> 'a'")
    with pytest.raises(Exception, match="no weight for label a"):
        bce_loss(logits(spark), ["a", "b"], lacking).collect()


def test_asymmetric_loss_and_its_options(spark):
    x, y = np.array([2.0, -30.0, -1.0, 40.0]), np.array([1, 0, 0, 1])
    p = sigma(x)
    for clip in (0.05, None):
        q = np.minimum(1 - p + clip, 1) if clip else 1 - p
        cell = y * np.log(np.maximum(p, 1e-8)) + (1 - y) * np.log(np.maximum(q, 1e-8))
        focus = (1 - p * y - q * (1 - y)) ** (1 * y + 4 * (1 - y))
        found = asymmetric_loss(logits(spark), ["a", "b"], clip=clip).first()[0]
        assert found == pytest.approx(-(cell * focus).sum())
        plain = asymmetric_loss(logits(spark), ["a", "b"], 0, 0, clip).first()[0]
        assert plain == pytest.approx(-cell.sum())


def test_single_label_loss(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 0.5], 1), (1, [0.0, 0.0, 3.0], 0)], "id int, x array<double>, y int")
    losses = []
    for x, y in (([1.0, 2.0, 0.5], 1), ([0.0, 0.0, 3.0], 0)):
        lp = np.array(x) - np.log(np.exp(x).sum())
        t = np.eye(3)[y]
        w = (1 - np.exp(lp) * t - (1 - np.exp(lp)) * (1 - t)) ** (4 * (1 - t))
        losses.append(-((t * 0.9 + 0.1 / 3) * lp * w).sum())
    assert single_label_loss(df, "x", "y", 3).first()[0] == pytest.approx(np.mean(losses))
    rows = single_label_loss(df, "x", "y", 3, reduction="none").orderBy("id").collect()
    assert [r["single_label_loss"] for r in rows] == pytest.approx(losses)


def test_contrastive_loss_by_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, size=(9, 3))
    rows = [(i // 5, i, x[i].tolist(), y[i].tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "batch long, row_id int, embedding array<double>, labels array<int>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for anchor in ("all", "first"):
        found = dict(contrastive_loss(df.repartition(3), anchor=anchor).collect())
        for batch, members in ((0, range(5)), (1, range(5, 9))):
            total = 0.0
            for i in list(members)[: 1 if anchor == "first" else None]:
                others = [j for j in members if j != i]
                c = 1e-12 + sum(float(y[i] @ y[j]) for j in others)
                e = 1e-12 + sum(np.exp(-np.linalg.norm(u[i] - u[j]) / 0.1) for j in others)
                total += sum(
                    -(y[i] @ y[j]) / c * np.log(np.exp(-np.linalg.norm(u[i] - u[j]) / 0.1) / e) for j in others
                )
            assert found[batch] == pytest.approx(total / len(members))


def test_label_overlap_counts_the_others(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (0, 0, 1), (1, 1, 1)], "batch int, a int, b int")
    found = sorted((r["batch"], r["a"], r["b"], r["overlap"]) for r in label_overlap(df, ["a", "b"]).collect())
    assert found == [(0, 0, 1, 1), (0, 1, 0, 1), (0, 1, 1, 2), (1, 1, 1, 0)]


def test_softmax_and_norm_edges(spark):
    row = spark.range(1).select(
        log_softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("big"),
        masked_softmax(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(1), F.lit(0))).alias("masked"),
        l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
    ).first()
    assert row["big"] == pytest.approx([np.log(0.5)] * 2)
    assert row["masked"] == pytest.approx([1.0, 0.0])
    assert row["zero"] == [0.0, 0.0]
