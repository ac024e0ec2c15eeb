"""Readers and writers of the tables the library works on."""

from labelloom.sources.stores import (
    load_index,
    load_linear_model,
    read_linear_json,
    save_index,
    save_index_if_best,
    save_linear_model,
    write_linear_json,
    write_fold_tables,
)
from labelloom.sources.tables import (
    read_arguments,
    read_labels,
    read_predictions,
    write_tsv,
)
from labelloom.sources.taxonomy import parse_taxonomy, read_taxonomy, read_taxonomy_lines
from labelloom.sources.weights import malformed_lines, parse_weights, read_weights

__all__ = [
    "load_index",
    "load_linear_model",
    "malformed_lines",
    "parse_taxonomy",
    "parse_weights",
    "read_arguments",
    "read_labels",
    "read_linear_json",
    "read_predictions",
    "read_taxonomy",
    "read_taxonomy_lines",
    "read_weights",
    "save_index",
    "save_index_if_best",
    "save_linear_model",
    "write_linear_json",
    "write_fold_tables",
    "write_tsv",
]
