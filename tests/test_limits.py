"""Nothing is dropped in silence: unequal sides, stray epochs, empty tables, soft targets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions.losses import asymmetric_cell
from labelloom.operators.combine import attach_by_position
from labelloom.operators.folds import assign_folds
from labelloom.operators.inference import blended_scores
from labelloom.operators.losses import _batch_loss, contrastive_loss
from labelloom.operators.metrics import confusion, elementwise_accuracy
from labelloom.operators.positions import file_position
from labelloom.operators.rollup import taxonomy_levels
from labelloom.operators.selection import best_epoch
from labelloom.sources.tables import read_arguments
from labelloom.sources.taxonomy import parse_taxonomy
from labelloom.streaming import stream_arguments


def test_unequal_tables_are_not_put_side_by_side(spark):
    left, right = spark.range(5).withColumnRenamed("id", "a"), spark.range(8).withColumnRenamed("id", "b")
    for one, other in ((left, right), (right, left)):
        with pytest.raises(Exception, match="differ in length"):
            attach_by_position(one, other, one.columns, other.columns).collect()
    same = attach_by_position(left, right.where("b < 5"), ["a"], ["b"]).collect()
    assert sorted((r.row_pos, r.a, r.b) for r in same) == [(i, i, i) for i in range(5)]


@pytest.mark.parametrize("rows", [[("x", 12, 0.9)], [("x", -1, 0.9)], [("x", 2, 0.1), ("x", 2, 0.2)], [("x", None, 0.1)]])
def test_stray_epochs_are_refused(spark, rows):
    log = spark.createDataFrame([("x", 1, 0.5), *rows], "fold string, epoch int, f1 double")
    with pytest.raises(Exception, match="out of range or repeated"):
        best_epoch(log, 10).collect()


def test_both_layouts_give_every_label_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g int, t_a int, p_a int, t_b int, p_b int")
    for group, want in ((), {("a", 0, 0, 0, 0), ("b", 0, 0, 0, 0)}), (("g",), set()):
        for layout in ("wide", "long"):
            assert {tuple(r) for r in confusion(empty, ["a", "b"], group, layout).collect()} == want


def test_soft_and_null_targets(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, None), (1.0, 1.0), (-2.0, 0.0)], "x double, y double")
    found = [r[0] for r in df.select(asymmetric_cell(F.col("x"), F.col("y"))).collect()]

    def formula(x, y):
        p = 1 / (1 + math.exp(-x))
        q = min(1 - p + 0.05, 1)
        weight = (1 - (p * y + q * (1 - y))) ** (y * 1 + (1 - y) * 4)
        return -(y * math.log(p) + (1 - y) * math.log(q)) * weight

    assert found[1] is None
    assert found[0] == pytest.approx(formula(1.0, 0.5)) and round(found[0], 4) == 0.1132
    assert found[2] == pytest.approx(formula(1.0, 1.0)) and found[3] == pytest.approx(formula(-2.0, 0.0))


def test_a_null_score_is_one_miss(spark):
    df = spark.createDataFrame([(1, 0, 0.9, None), (1, 0, 0.9, 0.1)], "t_a int, t_b int, s_a double, s_b double")
    assert elementwise_accuracy(df, ["a", "b"]).first()[0] == 0.75


def test_categories_of_parts_keep_their_order(spark):
    parts = [(1, '{"D": {"d": []}}'), (0, '{"A": {"a": []}, "B": {"b": [], "c": []}, "C": {"e": []}}')]
    df = spark.createDataFrame(parts, "pos int, json string")
    names = taxonomy_levels(parse_taxonomy(df, "json", F.col("pos"))).where("level = 2").orderBy("pos")
    assert [r.name for r in names.collect()] == ["A", "B", "C", "D"]
    rows = spark.createDataFrame([(j,) for _, j in reversed(parts)], "json string").coalesce(1)
    names = taxonomy_levels(parse_taxonomy(rows)).where("level = 2").orderBy("pos")
    assert [r.name for r in names.collect()] == ["A", "B", "C", "D"]


def test_repeated_keys_are_found_before_folds(spark):
    df = spark.createDataFrame([(i % 10,) for i in range(100)], "id int")
    with pytest.raises(ValueError, match="repeated"):
        assign_folds(df, ["id"], check=True)
    assert assign_folds(df.distinct(), ["id"], 2, check=True).groupBy("fold").count().count() == 2


def test_neighbours_too_far_away_count_as_none(spark):
    scored = spark.createDataFrame([(1, [0.8], [0.0, 0.0])], "query_id int, scores array<double>, embedding array<double>")
    index = spark.createDataFrame([(7, [1e6, 0.0], [1])], "row_id int, embedding array<double>, labels array<int>")
    assert blended_scores(scored, index, ["a"]).first()["a"] == pytest.approx(0.6)


def test_large_batches_are_refused_and_distances_agree(spark):
    df = spark.createDataFrame([(0, i, [float(i), 1.0], [1]) for i in range(6)],
                               "batch int, row_id int, embedding array<double>, labels array<int>")
    with pytest.raises(Exception, match="batch too large"):
        contrastive_loss(df, most=5).collect()
    x, y = np.random.default_rng(1).normal(size=(9, 4)), np.ones((9, 2))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    gap = np.linalg.norm(unit[:, None] - unit[None], axis=2) / 0.1
    near = np.exp(-gap) * (1 - np.eye(9))
    shared = (y @ y.T) * (1 - np.eye(9))
    want = ((shared / shared.sum(axis=1, keepdims=True)) * (gap + np.log(near.sum(axis=1))[:, None])).sum() / 9
    assert _batch_loss(x, y, 0.1, "all") == pytest.approx(want)


def test_stream_keeps_the_usage(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tsv").write_text("Argument ID\tConclusion\tStance\tPremise\tUsage\n1\tc\tagainst\tp\ttrain\n2\tc\tagainst\tp\t\n")
    (folder / "b.tsv").write_text("Argument ID\tConclusion\tStance\tPremise\n3\tc\tagainst\tp\n")
    query = (
        stream_arguments(spark, str(folder)).writeStream.format("memory").queryName("usages")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.awaitTermination(120)
    assert {r["Argument ID"]: r["Usage"] for r in spark.table("usages").collect()} == {"1": "train", "2": "test", "3": "test"}


def test_linear_json_round_trip(spark, tmp_path):
    from labelloom.operators.linear import LinearModel, linear_margins
    from labelloom.sources import read_linear_json, write_linear_json

    terms = spark.createDataFrame([('say "b"', 1.5), ("a", 1.25), ("c", 2.0)], "term string, idf double")
    coefs = [("x: y", "a", 0.5), ("x: y", 'say "b"', -1e-9), ("z", "c", 3.0)]
    model = LinearModel(
        ("x: y", "z"),
        terms,
        spark.createDataFrame(coefs, "label string, term string, coef double"),
        spark.createDataFrame([("z", -0.25), ("x: y", 0.125)], "label string, intercept double"),
    )
    write_linear_json(model, str(tmp_path / "v"), str(tmp_path / "m"))
    again = read_linear_json(spark, str(tmp_path / "v"), str(tmp_path / "m"), ["x: y", "z"])
    assert {(r.term, r.idf) for r in again.terms.collect()} == {("a", 1.25), ("c", 2.0), ('say "b"', 1.5)}
    assert {tuple(r) for r in again.coefs.where("coef <> 0").select("label", "term", "coef").collect()} == set(coefs)
    assert {tuple(r) for r in again.intercepts.collect()} == {("x: y", 0.125), ("z", -0.25)}
    docs = spark.createDataFrame([(1, "aa a cc")], "id int, t string")
    assert linear_margins(docs, again, "id", "t").first()["z"] == -0.25


def test_index_is_saved_on_a_new_best_only(spark, tmp_path):
    from labelloom.sources import load_index, save_index_if_best

    index = spark.createDataFrame([(1, [0.5])], "row_id int, embedding array<double>")
    path = str(tmp_path / "index")
    log = [("r", 0, 0.5), ("r", 1, 0.4)]
    schema = "fold string, epoch int, f1 double"
    assert not save_index_if_best(index, spark.createDataFrame(log, schema), 10, path)
    assert save_index_if_best(index, spark.createDataFrame([*log, ("r", 2, 0.6)], schema), 10, path)
    assert load_index(spark, path).count() == 1


def test_values_outside_the_taxonomy_are_not_lost(spark):
    from labelloom.operators.rollup import roll_up_long

    taxonomy = spark.createDataFrame([("care", "help"), ("care", "love"), ("power", "rule")], "category string, value string")
    cells = spark.createDataFrame(
        [(1, "help", 1), (1, "love", 0), (1, "rule", 0), (2, "stray", 1), (2, None, 1)], "id long, value string, y int"
    )
    kept = roll_up_long(cells, taxonomy, ["id"], unknown="keep").collect()
    assert {tuple(r) for r in kept} == {(1, "care", 1), (1, "power", 0), (2, None, 1)}
    known = roll_up_long(cells.where("id = 1"), taxonomy, ["id"])
    assert {tuple(r) for r in known.collect()} == {(1, "care", 1), (1, "power", 0)}
    with pytest.raises(Exception, match="outside the taxonomy: (stray|null)"):
        roll_up_long(cells, taxonomy, ["id"]).collect()


def test_one_pass_gives_the_weights_of_two(spark):
    from labelloom.operators.tfidf import counted_idf, fit_idf, fit_tfidf, term_counts, tfidf

    docs = spark.createDataFrame(
        [(1, "red apple red"), (2, "green apple"), (3, ""), (4, None), (5, "red the pear")], "id long, t string"
    )
    twice = tfidf(docs, fit_idf(docs, "t", ["the"]), "id", "t", ["the"])
    once = fit_tfidf(docs, "id", "t", ["the"])
    assert {(r[0], r[1], r[2], round(r[3], 12)) for r in once.collect()} == {
        (r[0], r[1], r[2], round(r[3], 12)) for r in twice.collect()
    }
    counts = term_counts(docs, "id", "t", ["the"], keep_empty=True)
    assert {tuple(r) for r in counted_idf(counts, docs).collect()} == {tuple(r) for r in fit_idf(docs, "t", ["the"]).collect()}
    plan = term_counts(docs, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the texts; their counts need none


def test_file_position_follows_the_files(spark, tmp_path):
    """Two inputs of several files, each cut into many blocks; ids in no order, some repeated."""
    rng = np.random.default_rng(3)
    inputs, want = [], []
    for name in ("later", "early"):
        folder = tmp_path / name
        folder.mkdir()
        for part in range(3):
            ids = rng.integers(0, 400, 150).tolist()
            lines = [f"a{i}\ttext of {i}" for i in ids]
            (folder / f"part-{part}.tsv").write_text("\n".join(["Argument ID\tPremise", *lines]) + "\n")
            want += [f"a{i}" for i in ids]
        inputs.append(str(folder))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        frames = [read_arguments(spark, path) for path in inputs]
        assert frames[0].rdd.getNumPartitions() > 3
        found = file_position(frames, ["Argument ID"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["Argument ID"] for r in sorted(found, key=lambda r: r["row_pos"])] == want
    assert sorted(r["row_pos"] for r in found) == list(range(900))
    (tmp_path / "none.tsv").write_text("Argument ID\tPremise\n")
    assert file_position([read_arguments(spark, str(tmp_path / "none.tsv"))], ["Argument ID"]).count() == 0


def test_words_are_counted_inside_their_row(spark):
    """No table of all words of a task: only texts are grouped, by id. Ids may repeat or be null."""
    from labelloom.operators.crossval import fold_term_counts
    from labelloom.operators.tfidf import term_counts

    rows = [(1, 1, "bb aa bb"), (1, 1, "aa cc"), (2, 1, None), (None, 2, "cc cc"), (None, 2, ""), (3, 2, "the")]
    docs = spark.createDataFrame(rows, "id long, fold int, t string")
    want = {(1, "aa", 2), (1, "bb", 2), (1, "cc", 1), (None, "cc", 2)}
    assert {tuple(r) for r in term_counts(docs, "id", "t", ["the"]).collect()} == want
    kept = term_counts(docs, "id", "t", ["the"], keep_empty=True)
    assert {(r[0], r[1]) for r in kept.collect()} == {w[:2] for w in want} | {(2, None), (3, None)}
    for counts in (kept, fold_term_counts(docs, "id", "t", ["the"])):
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate(keys=[id" not in plan.replace("ObjectHashAggregate", "Object") and "term" not in plan.split("Aggregate", 1)[1].split("]")[0]
