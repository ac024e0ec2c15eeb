"""Column checks, projections and row filters on arguments and label tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from labelloom.functions.labels import labels_to_vector, vector_columns
from labelloom.functions.text import stance_premise

# The three usages a data set is split by.
USAGES = ("train", "validation", "test")


class MissingColumnError(ValueError):
    """Raised when a table lacks a column it must have."""


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or name the columns it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnError(f"{what} lacks the column(s) {', '.join(missing)}")
    return df


def with_default(df: DataFrame, name: str, value: object) -> DataFrame:
    """Add a constant column unless the table already has it."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def split_by_value(
    df: DataFrame, column: str = "Usage", values: Sequence[str] = USAGES
) -> tuple[DataFrame, ...]:
    """One table per value of ``column``, without that column.

    On a table partitioned by the column each part reads its own folder only.
    """
    return tuple(df.filter(F.col(column) == v).drop(column) for v in values)


def select_labels(df: DataFrame, labels: Sequence[str], id_column: str = "Argument ID") -> DataFrame:
    """The id and the labels, in the order asked for."""
    require_columns(df, [id_column, *labels], "label table")
    return df.select(id_column, *[F.col(f"`{name}`") for name in labels])


def keep_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def with_label_vector(
    df: DataFrame, labels: Sequence[str], out: str = "labels", keep_labels: bool = False
) -> DataFrame:
    """Wide label columns replaced by one ``array<int>``."""
    require_columns(df, labels, "label table")
    widened = df.withColumn(out, labels_to_vector(labels))
    return widened if keep_labels else widened.drop(*labels)


def spread_vector(
    df: DataFrame, vector: str, labels: Sequence[str], type_name: str | None = None
) -> DataFrame:
    """A vector column replaced by one column per label."""
    others = [F.col(f"`{c}`") for c in df.columns if c != vector]
    return df.select(*others, *vector_columns(vector, labels, type_name))


def unpivot_labels(
    df: DataFrame,
    labels: Sequence[str],
    keep: Sequence[str],
    value: str = "y",
    label: str = "label",
) -> DataFrame:
    """Wide labels as rows ``(keep…, label, value)``; narrow, no shuffle."""
    cells = [F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in labels]
    return df.select(*keep, F.inline(F.array(*cells)))


def with_stance_prefix(
    df: DataFrame,
    conclusion: str = "Conclusion",
    stance: str = "Stance",
    premise: str = "Premise",
) -> DataFrame:
    """Premise rewritten as a sentence that states the stance first."""
    rewritten = stance_premise(F.col(conclusion), F.col(stance), F.col(premise))
    return df.withColumn(premise, rewritten)


def prediction_head(
    df: DataFrame, id_column: str = "Argument ID", method: str | None = None
) -> DataFrame:
    """The id column that predictions are attached to, optionally with the method's name."""
    head = df.select(id_column)
    return head if method is None else head.withColumn("Method", F.lit(method))


def predict_one_baseline(
    df: DataFrame, labels: Sequence[str], id_column: str = "Argument ID"
) -> DataFrame:
    """Predict 1 for every label of every row."""
    return df.select(id_column, *[F.lit(1).alias(name) for name in labels])


def drop_marked(df: DataFrame, column: str, mark: object) -> DataFrame:
    """Drop the rows whose column holds the mark."""
    return df.filter(F.col(column) != F.lit(mark))


def preview(df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows in a stated order (a top-n per task, then one merge)."""
    return df.orderBy(*order).limit(rows)


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept, columns matched by name."""
    for other in others:
        first = first.unionByName(other)
    return first


def label_dataset(
    train: DataFrame, test: DataFrame, labels: Sequence[str], text: str = "Premise"
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test as ``(text, labels array)`` with one shared label order.

    The labels used are those of the list that the training table has; the test
    table must have the same ones.
    """
    used = [name for name in labels if name in train.columns]
    require_columns(test, used, "test table")
    tables = tuple(
        with_label_vector(keep_present(part, [text, *used]), used) for part in (train, test)
    )
    return tables[0], tables[1], used
