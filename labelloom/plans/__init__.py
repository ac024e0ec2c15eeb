"""The three jobs: train, predict, evaluate."""

from labelloom.plans.evaluate import Evaluation, evaluate, evaluate_files
from labelloom.plans.predict import ensemble_vote, predict_fold_ensemble, predict_levels, predict_text_model
from labelloom.plans.train import build_fold_index, cross_validate_svm, prepare, train_levels

__all__ = [
    "Evaluation",
    "build_fold_index",
    "cross_validate_svm",
    "ensemble_vote",
    "evaluate",
    "evaluate_files",
    "predict_fold_ensemble",
    "predict_levels",
    "predict_text_model",
    "prepare",
    "train_levels",
]
