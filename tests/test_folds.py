"""Folds, positions, batches, sampling."""

import hashlib
from collections import Counter

import pytest

from labelloom.operators.folds import assign_folds, fold_pair, fold_splits, group_leakage
from labelloom.operators.positions import row_position, seeded_batches, seeded_position


def order_keys(ids, seed):
    return sorted(f"{hashlib.md5(f'{seed}:{i}'.encode()).hexdigest()}:{i}" for i in ids)


@pytest.mark.parametrize(("rows", "folds"), [(100, 6), (5, 6), (7, 7), (1, 2), (64, 1)])
def test_exact_folds_follow_the_seeded_order(spark, rows, folds):
    df = spark.range(rows).repartition(3)
    found = {r["id"]: r["fold"] for r in assign_folds(df, ["id"], folds, 2).collect()}
    small, extra = divmod(rows, folds)
    sizes = Counter(found.values())
    assert [sizes.get(f, 0) for f in range(1, folds + 1)] == [small + (f < extra) for f in range(folds)]
    expected, at = {}, 0
    keys = order_keys(range(rows), 2)
    for fold in range(1, folds + 1):
        for key in keys[at : at + small + (fold <= extra)]:
            expected[int(key.split(":")[1])] = fold
        at += small + (fold <= extra)
    assert found == expected


def test_folds_do_not_depend_on_partitions(spark):
    df = spark.range(200)
    one = set(assign_folds(df.coalesce(1), ["id"]).collect())
    assert one == set(assign_folds(df.repartition(7), ["id"]).collect())


def test_splits_hold_every_row_once_per_fold(spark):
    splits = fold_splits(assign_folds(spark.range(20), ["id"], 4), 4)
    seen = Counter((r["id"], r["split"]) for r in splits.collect())
    assert all(seen[(i, "valid")] == 1 and seen[(i, "train")] == 3 for i in range(20))
    train, valid = fold_pair(assign_folds(spark.range(20), ["id"], 4), 2)
    assert train.count() == 15 and valid.count() == 5


def test_grouped_folds_do_not_leak(spark):
    df = spark.range(300).selectExpr("id", "id % 10 AS conclusion")
    assert group_leakage(assign_folds(df, ["id"], group="conclusion"), "conclusion").count() == 0
    assert group_leakage(assign_folds(df, ["id"]), "conclusion").count() == 10


def test_positions(spark):
    df = spark.range(1000).repartition(5)
    placed = {r["id"]: r["row_pos"] for r in row_position(df, ["id"]).collect()}
    assert placed == {i: i for i in range(1000)}
    shuffled = {r["id"]: r["position"] for r in seeded_position(df, ["id"], "s").collect()}
    expected = {int(k.split(":")[1]): n for n, k in enumerate(order_keys(range(1000), "s"))}
    assert shuffled == expected


def test_batches_have_a_fixed_size_and_differ_by_epoch(spark):
    df = spark.range(50)
    first = seeded_batches(df, ["id"], 2, 24).collect()
    assert sorted(Counter(r["batch"] for r in first).values()) == [2, 24, 24]
    assert set(first) != set(seeded_batches(df, ["id"], 2, 24, epoch=1).collect())
