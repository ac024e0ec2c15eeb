"""Cross-validation of linear text models for all folds at once.

The texts are cut into words once. What a fold's model learns from is everything but the
fold itself, so its document frequencies are those of all documents less its own; and a row
is scored by the one model that did not see it, so no row is copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelloom.functions.labels import binarize
from labelloom.operators.linear import MARGIN
from labelloom.operators.metrics import confusion, precision_recall_f1
from labelloom.operators.tfidf import counted_words


def fold_term_counts(
    docs: DataFrame, id_column: str, text: str, stop_words: Sequence[str] = (), fold: str = "fold"
) -> DataFrame:
    """``(id, fold, term, tf)``, dealt by id; a document without words is one row with a null term.

    The rows serve every later step, so write them once.
    """
    dealt = docs.select(id_column, fold, text).repartition(F.col(id_column))
    texts = dealt.groupBy(id_column, fold).agg(F.collect_list(text).alias("_texts"))
    return texts.select(id_column, fold, F.inline_outer(counted_words(F.col("_texts"), stop_words)))


def fold_idf(counts: DataFrame, docs: DataFrame, fold: str = "fold") -> DataFrame:
    """``(fold, term, df, idf)`` as fitted on the documents outside each fold.

    One aggregation by term counts every fold beside the others; a term that only a fold
    itself holds is not in that fold's vocabulary. Folds are few: one column each.
    """
    sizes = {r[fold]: r["n"] for r in docs.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}
    everything = sum(sizes.values())
    known = counts.where(F.col("term").isNotNull())
    inside = [F.count_if(F.col(fold) == f).alias(f"_{i}") for i, f in enumerate(sizes)]
    per_term = known.groupBy("term").agg(F.count(F.lit(1)).alias("_all"), *inside)
    outside = [
        F.struct(
            F.lit(f).alias(fold),
            (F.col("_all") - F.col(f"_{i}")).alias("df"),
            F.lit(1.0 + everything - n).alias("_n"),
        )
        for i, (f, n) in enumerate(sizes.items())
    ]
    empty = f"array<struct<`{fold}`: int, df: bigint, _n: double>>"
    rows = per_term.select("term", F.inline(F.array(*outside) if outside else F.array().cast(empty)))
    idf = F.log(F.col("_n") / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return rows.where(F.col("df") > 0).select(fold, "term", "df", idf.alias("idf"))


def held_out_margins(
    counts: DataFrame,
    terms: DataFrame,
    coefs: DataFrame,
    intercepts: DataFrame,
    labels: Sequence[str],
    id_column: str = "Argument ID",
    fold: str = "fold",
) -> DataFrame:
    """``(id, fold, <label>…)``: every row's margins under the model of its own fold.

    ``terms(fold, term, idf)``, ``coefs(fold, label, term, coef)`` and
    ``intercepts(fold, label, intercept)`` hold the models of all folds. Words that a model does
    not know count for nothing. The join has no hint: Spark broadcasts by measured size or
    shuffles, splitting hot terms; rows without a word get keys of their own.
    """
    own = [F.sum(F.when(F.col("label") == n, F.col("coef")).otherwise(0.0)).alias(f"_c{i}") for i, n in enumerate(labels)]
    weights = terms.select(fold, "term", "idf").join(coefs.groupBy(fold, "term").agg(*own), [fold, "term"], "left")
    # no term holds a blank, so these keys meet nothing
    key = F.coalesce(F.col("term"), F.concat(F.lit(" "), F.col(f"`{id_column}`").cast("string")))
    cells = counts.withColumn("term", key).join(weights, [fold, "term"], "left")
    w = F.coalesce(F.col("tf") * F.col("idf"), F.lit(0.0))
    sums = cells.groupBy(id_column, fold).agg(
        F.sqrt(F.sum(w * w)).alias("_norm"),
        *[F.sum(w * F.coalesce(F.col(f"_c{i}"), F.lit(0.0))).alias(f"_s{i}") for i in range(len(labels))],
    )
    # one row per fold and label: a map in every row instead of a join on a few hot keys
    name = F.struct(F.col(fold), F.col("label"))
    shift = intercepts.agg(F.map_from_entries(F.collect_list(F.struct(name, F.col("intercept")))).alias("m"))
    sums = sums.withColumn("_shift", shift.scalar())
    margins = [
        F.coalesce(F.try_divide(F.col(f"_s{i}"), F.col("_norm")), F.lit(0.0))
        + F.try_element_at("_shift", F.struct(F.col(fold), F.lit(n).alias("label")))
        for i, n in enumerate(labels)
    ]
    return sums.select(id_column, fold, *[m.alias(n) for m, n in zip(margins, labels)])


def held_out_f1(
    margins: DataFrame, truth: DataFrame, labels: Sequence[str], id_column: str = "Argument ID",
    fold: str = "fold", threshold: float = MARGIN,
) -> DataFrame:
    """``(fold, label, f1)`` of held-out margins, cut at ``margin >= threshold``."""
    cut = [binarize(F.col(f"`{n}`"), threshold, True).alias(f"p_{n}") for n in labels]
    told = truth.select(id_column, *[F.col(f"`{n}`").alias(f"t_{n}") for n in labels])
    aligned = margins.select(id_column, fold, *cut).join(told, id_column)
    return precision_recall_f1(confusion(aligned, labels, [fold])).select(fold, "label", "f1")
