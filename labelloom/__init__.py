"""Multi-label text classification data work as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from labelloom.functions.losses import asymmetric_cell
from labelloom.operators.columns import MissingColumnError, predict_one_baseline
from labelloom.operators.combine import AlignmentError
from labelloom.operators.linear import LinearModel, predict_svm, train_svm
from labelloom.operators.losses import asymmetric_loss
from labelloom.plans import build_fold_index, evaluate, evaluate_files, predict_text_model

# Functions of this package travel to the Python workers as code, so the package need not
# be installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "AlignmentError",
    "LinearModel",
    "MissingColumnError",
    "asymmetric_cell",
    "asymmetric_loss",
    "build_fold_index",
    "evaluate",
    "evaluate_files",
    "predict_one_baseline",
    "predict_svm",
    "predict_text_model",
    "train_svm",
]
