"""Column functions: every one maps columns to a column and stays in the JVM."""

from labelloom.functions.labels import (
    binarize,
    blend,
    labels_to_vector,
    one_hot,
    smooth_labels,
    vector_columns,
)
from labelloom.functions.losses import (
    asymmetric_cell,
    asymmetric_single_label,
    bce_with_logits,
    sigmoid,
)
from labelloom.functions.portable import digest, uniform
from labelloom.functions.text import (
    attention_mask,
    pad_tokens,
    split_words,
    stance_premise,
    swap_adjacent,
    swap_rounds,
    english_stop_words,
    word_tokens,
)
from labelloom.functions.vectors import (
    dot,
    euclidean,
    kernel,
    l2_normalize,
    log_softmax,
    masked_softmax,
    softmax,
)

__all__ = [
    "asymmetric_cell",
    "asymmetric_single_label",
    "attention_mask",
    "bce_with_logits",
    "binarize",
    "blend",
    "digest",
    "dot",
    "euclidean",
    "kernel",
    "l2_normalize",
    "labels_to_vector",
    "log_softmax",
    "masked_softmax",
    "one_hot",
    "pad_tokens",
    "sigmoid",
    "smooth_labels",
    "softmax",
    "split_words",
    "stance_premise",
    "swap_adjacent",
    "swap_rounds",
    "uniform",
    "vector_columns",
    "english_stop_words",
    "word_tokens",
]
