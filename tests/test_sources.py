"""File formats, text functions, augmentation, selection, stream."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from labelloom.functions.text import (
    attention_mask,
    pad_tokens,
    split_words,
    swap_adjacent,
    swap_rounds,
    word_tokens,
)
from labelloom.operators.augment import augment
from labelloom.operators.columns import (
    MissingColumnError,
    label_dataset,
    split_by_value,
    with_stance_prefix,
)
from labelloom.operators.inference import hashed_encoder
from labelloom.operators.rollup import label_descriptions, roll_up_wide, taxonomy_levels
from labelloom.operators.selection import best_epoch
from labelloom.plans import build_fold_index, ensemble_vote, evaluate_files, prepare
from labelloom.plans.predict import predict_text_model
from labelloom.sources import (
    read_arguments,
    read_labels,
    read_taxonomy,
    read_weights,
    write_tsv,
)
from labelloom.streaming import stream_arguments, write_stream

ARGUMENTS = (
    "Argument ID\tConclusion\tStance\tPremise\n"
    'A1\tWe should plant trees\tin favor of\ta "green" city is a \\ better city\n'
    'A2\tWe should plant trees\tagainst\t"quoted" from the start\n'
    "A3\tWe should rest\tin favor of\trest\n"
)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "arguments.tsv").write_text(ARGUMENTS)
    (tmp_path / "labels.tsv").write_text(
        "Argument ID\tJoy: small\tJoy: big\nA1\t1\t0\nA2\t0\t0\nA3\t1\t1\n"
    )
    return tmp_path


def test_arguments_keep_quotes_and_get_a_usage(spark, files):
    df = read_arguments(spark, str(files / "arguments.tsv"), "train")
    rows = {r["Argument ID"]: r for r in df.collect()}
    assert rows["A1"]["Premise"] == 'a "green" city is a \\ better city'
    assert rows["A2"]["Premise"] == '"quoted" from the start'
    assert rows["A3"]["Usage"] == "train"
    train, validation, test = split_by_value(df)
    assert (train.count(), validation.count(), test.count()) == (3, 0, 0)
    assert "Usage" not in train.columns


def test_tsv_round_trip_and_refused_fields(spark, files, tmp_path):
    df = read_arguments(spark, str(files / "arguments.tsv"))
    write_tsv(df, str(tmp_path / "out"))
    assert sorted(read_arguments(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())
    bad = spark.createDataFrame([("A1", "two\tfields")], "`Argument ID` string, Premise string")
    with pytest.raises(Exception, match="tab or line end"):
        write_tsv(bad, str(tmp_path / "bad"))


def test_labels_come_in_the_asked_order(spark, files):
    df = read_labels(spark, str(files / "labels.tsv"), ["Joy: big", "Joy: small"])
    assert df.columns == ["Argument ID", "Joy: big", "Joy: small"]
    assert dict(df.dtypes)["Joy: big"] == "int"
    with pytest.raises(MissingColumnError, match="Anger"):
        read_labels(spark, str(files / "labels.tsv"), ["Anger"])
    with pytest.raises(MissingColumnError, match="Premise"):
        read_arguments(spark, str(files / "labels.tsv"))


def test_evaluate_files(spark, files):
    guess = files / "guess.tsv"
    guess.write_text("Argument ID\tJoy: small\tJoy: big\nA3\t1.0\t0\nA1\t0.0\t0.4\nA2\t0.0\t0\n")
    result = evaluate_files(spark, str(files / "labels.tsv"), str(guess))
    found = {r["label"]: r for r in result.per_label.collect()}
    assert found["Joy: small"]["recall"] == 0.5 and found["Joy: big"]["f1"] == 0.0
    assert result.macro.first()["macro_precision"] == 0.5


def test_weight_file(spark, tmp_path):
    path = tmp_path / "weights.dat"
    path.write_text("Joy: small, 2.5 \nonly one field\nthree,1,2\n\nJoy: big,0.25\n")
    rows = read_weights(spark, str(path)).orderBy("pos").collect()
    assert [(r["label"], r["pos_weight"]) for r in rows] == [("Joy: small", 2.5), ("Joy: big", 0.25)]
    path.write_text("Joy,much\n")
    with pytest.raises(Exception):
        read_weights(spark, str(path)).collect()


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "taxonomy.json"
    path.write_text('{\n"Zeal": {"Be quick": ["a", "b"], "Be bold": []},\n"Calm: deep": {"Be still": ["c"]}\n}')
    taxonomy = read_taxonomy(spark, str(path))
    levels = taxonomy_levels(taxonomy).orderBy("level", "pos").collect()
    assert [(r["level"], r["name"]) for r in levels] == [
        (1, "Be quick"), (1, "Be bold"), (1, "Be still"), (2, "Zeal"), (2, "Calm: deep"),
    ]
    assert dict(label_descriptions(taxonomy).collect()) == {
        "Zeal": "Zeal Be quick Be bold", "Calm: deep": "Calm: deep Be still",
    }
    flags = spark.createDataFrame([(0, 1, 0), (0, 0, 0)], "`Be quick` int, `Be bold` int, `Be still` int")
    rolled = roll_up_wide(flags, {"Zeal": ["Be quick", "Be bold"], "Calm: deep": ["Be still"]}, [])
    assert [tuple(r) for r in rolled.collect()] == [(1, 0), (0, 0)]


def test_stance_prefix(spark, files):
    df = with_stance_prefix(read_arguments(spark, str(files / "arguments.tsv")))
    rows = {r["Argument ID"]: r["Premise"] for r in df.collect()}
    assert rows["A2"].startswith('I disagree that We should plant trees, because "quoted"')
    assert rows["A3"] == "I agree that We should rest, because rest"


def test_tokens_padding_mask(spark):
    df = spark.createDataFrame([("A b2 the_End, l'été 7",), ("",)], "t string")
    first, empty = df.select(word_tokens(F.col("t"), ["THE_END"]).alias("w")).collect()
    assert first["w"] == ["b2", "été"] and empty["w"] == []
    row = df.select(
        pad_tokens(F.array(F.lit(5), F.lit(6)), 3).alias("p"),
        pad_tokens(F.array(*[F.lit(i) for i in range(5)]), 3).alias("cut"),
        attention_mask(F.array(F.lit(5), F.lit(6)), 3).alias("m"),
    ).first()
    assert row["p"] == [5, 6, 0] and row["cut"] == [0, 1, 2] and row["m"] == [1, 1, 0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abcdefg", min_size=1, max_size=4), max_size=40))
def test_swaps_only_reorder(words):
    from labelloom.session import local_session

    spark = local_session("tests")
    df = spark.createDataFrame([("k", " ".join(words))], "id string, t string")
    w = split_words(F.col("t"))
    row = df.select(swap_adjacent(w, swap_rounds(w), 1, "id").alias("s"), swap_rounds(w).alias("n")).first()
    assert sorted(row["s"]) == sorted(words)
    assert row["n"] == max(1, min(10, int(len(words) * 0.3)))
    if len(set(words)) == len(words) and row["n"] == 1 and len(words) > 1:
        assert row["s"] != words


def test_swaps_follow_each_other(spark):
    rows = [(f"k{i}", " ".join(f"w{j}" for j in range(i))) for i in range(60)]
    w = split_words(F.col("t"))
    df = spark.createDataFrame(rows, "id string, t string")
    for r in df.select("id", w.alias("w"), swap_adjacent(w, swap_rounds(w, 0.9, 1, 25), 4, "id").alias("s")).collect():
        want = list(r.w)
        for turn in range(1, max(1, min(25, int(len(want) * 0.9))) + 1):
            if len(want) > 1:
                draw = int(hashlib.md5(f"4:{r.id}:{turn}".encode()).hexdigest()[:8], 16) / 2**32
                at = int(draw * (len(want) - 1))
                want[at], want[at + 1] = want[at + 1], want[at]
        assert r.s == want


@pytest.mark.parametrize("rate", [0, 0.6, 1, 3.6])
def test_augment_rates(spark, rate):
    rows = [(f"A{i}", " ".join(random.Random(i).sample("one two three four five six".split(), 6)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "`Argument ID` string, Premise string, label int")
    out = augment(df, rate).collect()
    copies = [r for r in out if "_aug" in r["Argument ID"]]
    assert len(out) - len(copies) == 200
    whole, rest = int(rate), rate - int(rate)
    sampled = len(copies) - whole * 200
    assert (sampled == 0) if rest == 0 else abs(sampled - rest * 200) < 40
    originals = {r["Argument ID"]: r for r in out if "_aug" not in r["Argument ID"]}
    for r in copies:
        source = originals[r["Argument ID"].split("_aug")[0]]
        assert sorted(r["Premise"].split()) == sorted(source["Premise"].split()) and r["label"] == source["label"]
    assert len({r["Argument ID"] for r in out}) == len(out)


def test_one_word_text_is_unchanged(spark):
    df = spark.createDataFrame([("A", "word"), ("B", "")], "`Argument ID` string, Premise string")
    assert {r["Argument ID"]: r["Premise"] for r in augment(df, 1).collect()}["A_aug0"] == "word"


def log(spark, runs):
    rows = [(run, e, s) for run, scores in runs.items() for e, s in enumerate(scores)]
    return spark.createDataFrame(rows, "fold string, epoch int, f1 double").repartition(3)


def test_best_epoch(spark):
    runs = {
        "small steps": [0.5, 0.50015, 0.5003, 0.4],  # 0.50015 is too small a gain, 0.5003 is not
        "nothing": [0.0, 0.0001, 0.0002],
        "stops": [0.6] + [0.1] * 10 + [0.9],
    }
    found = {r["fold"]: r for r in best_epoch(log(spark, runs), 12).collect()}
    assert found["small steps"]["best_epoch"] == 2 and found["small steps"]["best_f1"] == 0.5003
    assert found["nothing"]["best_epoch"] is None
    # ten epochs without a gain by epoch 10, which is past the half of 12: 0.9 is never seen
    assert (found["stops"]["best_epoch"], found["stops"]["stop_epoch"]) == (0, 10)
    late = {r["fold"]: r for r in best_epoch(log(spark, runs), 30).collect()}
    assert late["stops"]["best_epoch"] == 11  # epoch 10 is not past the half of 30


def test_label_dataset_shares_the_order(spark):
    train = spark.createDataFrame([("t", 1, 0)], "Premise string, b int, a int")
    test = spark.createDataFrame([("u", 1, 0)], "Premise string, a int, b int")
    first, second, used = label_dataset(train, test, ["a", "b", "c"])
    assert used == ["a", "b"]
    assert first.first()["labels"] == [0, 1] and second.first()["labels"] == [1, 0]


def test_train_index_and_predict(spark, files):
    arguments = read_arguments(spark, str(files / "arguments.tsv"))
    names = ["Joy: small", "Joy: big"]
    prepared = prepare(arguments, read_labels(spark, str(files / "labels.tsv"), names), folds=3)
    index = build_fold_index(prepared, names, hashed_encoder(16))
    assert index.columns == ["fold", "row_id", "embedding", "labels"] and index.count() == 3

    def scorer(df, text, out):
        return df.withColumn(out, F.array(F.lit(1.0), F.lit(0.0)))

    result = predict_text_model(arguments, hashed_encoder(16), scorer, index, names, k=3)
    assert result.columns == ["Argument ID", *names]
    assert {tuple(r)[1:] for r in result.collect()} == {(1, 0)}
    voted = ensemble_vote(arguments, [result] * 6, names)
    assert voted.count() == 3


def test_stream_scores_like_the_batch(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(ARGUMENTS)
    stream = stream_arguments(spark, str(tmp_path / "in"))
    query = write_stream(stream, with_stance_prefix, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    expected = with_stance_prefix(read_arguments(spark, str(files / "arguments.tsv")))
    found = spark.read.parquet(str(tmp_path / "out")).select(expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect())


def test_command_line_trains_predicts_and_evaluates(spark, tmp_path, capsys):
    from labelloom.__main__ import main

    names = ["Zeal", "Calm: deep"]
    rows = [(f"A{i:02d}", "trees", "against" if i % 3 else "in favor of",
             f"argument {'quick bold' if i % 2 else 'still calm'} number{i % 5}") for i in range(36)]
    (tmp_path / "a.tsv").write_text("Argument ID\tConclusion\tStance\tPremise\n" + "".join("\t".join(r) + "\n" for r in rows))
    (tmp_path / "l.tsv").write_text(
        "Argument ID\t" + "\t".join(names) + "\n" + "".join(f"A{i:02d}\t{i % 2}\t{1 - i % 2}\n" for i in range(36))
    )
    (tmp_path / "t.json").write_text('{"Zeal": {"Be quick": []}, "Calm: deep": {"Be still": []}}')
    path = {n: str(tmp_path / n) for n in ("a.tsv", "l.tsv", "t.json", "models", "out")}
    main(["train", path["a.tsv"], path["l.tsv"], path["t.json"], path["models"], "--folds", "2"])
    main(["predict", path["models"], path["t.json"], path["out"], path["a.tsv"], "--folds", "2"])
    main(["evaluate", path["l.tsv"], path["out"]])
    assert "Calm: deep" in capsys.readouterr().out
    result = evaluate_files(spark, path["l.tsv"], path["out"])
    assert result.macro.first()["macro_f1"] == 1.0
    held = spark.read.option("sep", "\t").option("header", True).csv(f"{path['models']}/tables")
    assert held.filter("split = 'valid'").count() == 36 and held.filter("split = 'train'").count() == 36
