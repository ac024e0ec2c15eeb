"""Language-model scores: smoothed unigrams, and a log-bilinear model trained by NCE.

Tokens are lower-cased words and one end per document. The log-bilinear model predicts classes:
the ``CLASSES - 3`` most frequent words, the end, and one class for all other words, which
shares its probability among them by smoothed counts, so that the whole is a distribution over
all words and one unseen. The two words before give the context: ``p = c1 * r[w1] + c2 * r[w2]``
(elementwise), a class scores ``p . q[w] + b[w]``.

Training is noise-contrastive estimation in numpy, over every training token once: documents
are dealt into ``ROUNDS`` rounds; in a round each task starts from the same parameters, takes
its steps, and the tasks' parameters are averaged, weighted by tokens. Scoring is normalised:
batched matrix products give the log normaliser of every context beforehand, in tasks.

Counts of words come in two tiers. Up to ``TABLE_ROWS`` frequent words are numbered in a
broadcast table, and texts are stored once as numbers; numbered words are counted in the
training tasks. Every other word is a row with its 64-bit digest: a window over a word's rows
gives its count to each of them, and sums go back to the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelloom.llm.common import doc_id, row_key, stored

TABLE_ROWS = 1 << 18
TASK_TOP = 1 << 16
MOST_BYTES = 64
CLASSES = 1024
SIZE = 16
NOISE = 20
BATCH = 1024
ROUNDS = 3
RATE = 0.3
_COUNTER_ROWS = 1_000_000
_OTHER, _END, _START = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _rows(docs: DataFrame) -> DataFrame:
    """``_lm_id, text, row`` (a digest of both) and ``held_out``; a null id counts as ''."""
    check = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = row_key()[0]
    return docs.select(own, "text", F.xxhash64("doc_id", "text").alias("row"), (check % 10 == 0).alias("held_out"))


def frequent_words(rows: DataFrame, most: int = TABLE_ROWS) -> list[bytes]:
    """At most ``most`` frequent training words, the most frequent first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text))
                if len(seen) > _COUNTER_ROWS:
                    seen = Counter(dict(seen.most_common(_COUNTER_ROWS // 4)))
        top = [(w, n) for w, n in seen.most_common(TASK_TOP) if n > 1 and len(w) <= MOST_BYTES]
        yield pd.DataFrame(top, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    top = rows.where("NOT held_out").select("text").mapInPandas(count, "word binary, n long")
    ranked = top.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [w.as_py() for w in ranked.toArrow()["word"]]


class LogBilinear:
    """Parameters in one float32 vector; classes 0 other, 1 end, 2 start, then words."""

    def __init__(self, classes: int, size: int = SIZE):
        self.classes, self.size = classes, size
        self.flat = np.zeros(2 * classes * size + classes + 2 * size, np.float32)

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Views: context vectors r, target vectors q, biases b, context weights c."""
        n, d = self.classes, self.size
        r, q = flat[: n * d].reshape(n, d), flat[n * d : 2 * n * d].reshape(n, d)
        return r, q, flat[2 * n * d : 2 * n * d + n], flat[2 * n * d + n :].reshape(2, d)

    def start(self, share: np.ndarray, seed: int = 7) -> None:
        """Small random vectors, biases at the classes' log shares."""
        draw = np.random.default_rng(seed)
        r, q, b, c = self.parts(self.flat)
        r[:] = draw.normal(0, 0.1, r.shape)
        q[:] = draw.normal(0, 0.1, q.shape)
        b[:] = np.log(share)
        c[:] = 1.0

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised log probability of every class after each context ``(w1, w2)``."""
        r, q, b, c = self.parts(self.flat)
        score = (c[0] * r[contexts[:, 0]] + c[1] * r[contexts[:, 1]]) @ q.T + b
        score[:, _START] = -np.inf
        top = score.max(axis=1, keepdims=True)
        return score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))

    def log_normalisers(self, first: int) -> np.ndarray:
        """Log normalisers of the contexts ``(first, w2)`` of every ``w2``, in one matrix product."""
        r, q, b, c = self.parts(self.flat)
        score = (c[0] * r[first] + c[1] * r) @ q.T + b
        score[:, _START] = -np.inf
        top = score.max(axis=1)
        return top + np.log(np.exp(score - top[:, None]).sum(axis=1))

    def scores(self, w1: np.ndarray, w2: np.ndarray, target: np.ndarray) -> np.ndarray:
        r, q, b, c = self.parts(self.flat)
        return np.einsum("ij,ij->i", c[0] * r[w1] + c[1] * r[w2], q[target]) + b[target]

    def train(self, batches: Iterator[tuple], noise: np.ndarray, rate: float, draw: np.random.Generator) -> int:
        """Noise-contrastive steps (Adagrad) over batches of ``(w1, w2, target)``; tokens seen."""
        r, q, b, c = self.parts(self.flat)
        gradient = np.zeros_like(self.flat)
        squares = np.full_like(self.flat, 1e-2)
        gr, gq, gb, gc = self.parts(gradient)
        log_noise = np.log(NOISE * noise).astype(np.float32)
        tokens = 0
        for w1, w2, target in batches:
            n = len(target)
            tokens += n
            others = draw.choice(len(noise), NOISE, p=noise)
            r1, r2 = r[w1], r[w2]
            p = c[0] * r1 + c[1] * r2
            qt, qo = q[target], q[others]
            hit = np.einsum("ij,ij->i", p, qt) + b[target] - log_noise[target]
            miss = p @ qo.T + (b[others] - log_noise[others])
            up = 1 / (1 + np.exp(np.clip(hit, -30, 30)))
            down = -1 / (1 + np.exp(np.clip(-miss, -30, 30)))
            back = up[:, None] * qt + down @ qo
            gradient[:] = 0
            _add(gq, target, up[:, None] * p)
            np.add.at(gq, others, down.T @ p)
            gb += np.bincount(target, up, self.classes)
            np.add.at(gb, others, down.sum(axis=0))
            _add(gr, w1, back * c[0])
            _add(gr, w2, back * c[1])
            gc[0], gc[1] = (back * r1).sum(axis=0), (back * r2).sum(axis=0)
            gradient /= n
            squares += gradient**2
            self.flat += rate * gradient / np.sqrt(squares)
        return tokens


def _add(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``to[rows] += values`` with repeated rows summed first."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
    to[sorted_rows[first]] += np.add.reduceat(values[order], first, axis=0)


def _classes(numbers: np.ndarray, classes: int) -> np.ndarray:
    """Word numbers (-1 outside the table) as classes."""
    return np.where((numbers >= 0) & (numbers < classes - 3), numbers + 3, _OTHER).astype(np.int16)


def _sequence(numbers: np.ndarray, classes: int) -> np.ndarray:
    """Two starts, the words' classes, the end."""
    return np.concatenate(([_START, _START], _classes(numbers, classes), [_END])).astype(np.int16)


def _numbers(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))


def _contexts(sequences: Iterator[np.ndarray], size: int = BATCH) -> Iterator[tuple]:
    """``(w1, w2, target)`` of the sequences in batches of about ``size`` tokens."""
    waiting, n = [], 0
    for s in sequences:
        waiting.append((s[:-2], s[1:-1], s[2:]))
        n += len(s) - 2
        if n >= size:
            whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            for at in range(0, n, size):
                yield tuple(x[at : at + size] for x in whole)
            waiting, n = [], 0
    if n:
        whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        for at in range(0, n, size):
            yield tuple(x[at : at + size] for x in whole)


_ENCODED = "_lm_id long, row long, held_out boolean, numbers array<int>, rare array<long>"


def encoded(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """Texts as word numbers (-1 outside the table) and the digests of the words outside."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {w: i for i, w in enumerate(shared.value)}
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                numbers, rare = [], []
                for text in part["text"]:
                    words = words_of(text)
                    numbers.append(_numbers(words, index))
                    out = [digest(words[i]) for i in np.flatnonzero(numbers[-1] < 0).tolist()]
                    rare.append(np.array(out, np.uint64).view(np.int64))
                out = part[["_lm_id", "row", "held_out"]].copy()
                out["numbers"], out["rare"] = numbers, rare
                yield out

    return stored(rows.mapInPandas(encode, _ENCODED), "encoded-texts")


def train(texts: DataFrame, words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple:
    """``(model, counts, n_documents)``: the trained model, exact training counts by number."""
    spark = texts.sparkSession
    classes = min(classes, words + 3)
    counts, documents = np.zeros(words, np.int64), 0
    model = LogBilinear(classes)
    rough = np.ones(classes)
    model.start(rough / rough.sum())
    turns = F.pmod(F.shiftright("row", 7), F.lit(rounds))
    learning = texts.where("NOT held_out").select("numbers", turns.alias("turn"))
    size = len(model.flat)
    for turn in range(rounds):
        now = spark.sparkContext.broadcast((model.flat, rough / rough.sum()))

        def step(batches: Iterator[pd.DataFrame], now=now, first=turn == 0) -> Iterator[pd.DataFrame]:
            own = LogBilinear(classes)
            flat, noise = now.value
            found = np.zeros(words, np.int64)
            seen = np.zeros(2, np.int64)  # documents, words outside the table

            def sequences() -> Iterator[np.ndarray]:
                for batch in batches:
                    whole = np.concatenate([np.zeros(0, np.int32), *batch["numbers"]])
                    found[:] += np.bincount(whole[whole >= 0], minlength=words)
                    seen[:] += (len(batch), (whole < 0).sum())
                    for numbers in batch["numbers"]:
                        yield _sequence(numbers, classes)

            contexts = _contexts(sequences())
            if first:  # the first batches also give the biases' start and the noise
                head = [x for x, _ in zip(contexts, range(8))]
                if not head:
                    return
                share = np.bincount(np.concatenate([t for _, _, t in head]), minlength=classes) + 0.5
                noise = share / share.sum()
                own.flat[:] = flat
                own.parts(own.flat)[2][:] = np.log(noise)
                contexts = _chained(head, contexts)
            else:
                own.flat[:] = flat
            tokens = own.train(contexts, noise, RATE, np.random.default_rng(11))
            if tokens:
                at = np.flatnonzero(found)
                yield pd.DataFrame({"at": np.arange(size), "value": own.flat.astype(float) * tokens, "n": tokens})
                yield pd.DataFrame({"at": -1 - at, "value": 0.0, "n": found[at]})
                yield pd.DataFrame({"at": size + np.arange(2), "value": 0.0, "n": seen})

        parts = learning.where(F.col("turn") == turn).select("numbers").mapInPandas(step, "at long, value double, n long")
        sums = parts.groupBy("at").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).toArrow()
        at, value, n = (sums[c].to_numpy() for c in ("at", "value", "n"))
        weights = (at >= 0) & (at < size)
        if weights.any():
            model.flat[at[weights]] = value[weights] / n[weights]
        counts[-1 - at[at < 0]] += n[at < 0]
        documents += int(n[at == size].sum())
        outside = int(n[at == size + 1].sum())
        if turn == 0:
            rough[3:] = counts[: classes - 3] + 0.5
            rough[_END] = documents + 0.5
            rough[_OTHER] = counts[classes - 3 :].sum() + outside + 0.5
            rough[_START] = 0.5
    return model, counts, documents


def normalisers(spark: SparkSession, model: LogBilinear, parts: int = 64) -> np.ndarray:
    """Log normaliser of every context, ``[w1, w2]``: a row of the square table for each class,
    computed in tasks. Its size is the square of the classes, whatever the corpus."""
    classes, size = model.classes, model.size
    shared = spark.sparkContext.broadcast(model.flat)

    def norm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LogBilinear(classes, size)
        own.flat[:] = shared.value
        for batch in batches:
            for first in batch["id"].tolist():
                yield pd.DataFrame({"first": [first], "line": [own.log_normalisers(first).astype(np.float32).tobytes()]})

    found = spark.range(0, classes, 1, parts).mapInPandas(norm, "first long, line binary").toArrow()
    out = np.empty((classes, classes), np.float32)
    for first, line in zip(found["first"].to_pylist(), found["line"], strict=True):
        out[first] = np.frombuffer(line.as_py(), np.float32)
    return out


def _chained(head: list, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield from head
    yield from rest


def _rare(texts: DataFrame) -> DataFrame:
    """Per document with words outside the table: their number, how many are known, the sum of
    log10(count + 0.1), and of how many words this document is the first to hold them."""
    found = texts.select("row", "held_out", F.explode("rare").alias("word"))
    one = Window.partitionBy("word")
    counted = found.withColumn("c", F.count(F.when(~F.col("held_out"), 1)).over(one))
    counted = counted.withColumn("place", F.row_number().over(one.orderBy("row")))
    known = F.col("c") > 0
    return counted.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_rare"),
        F.count(F.when(known, 1)).alias("known_rare"),
        F.sum(F.log10(F.col("c") + 0.1)).alias("log_rare"),
        F.count(F.when(known & (F.col("place") == 1), 1)).alias("new_words"),
        F.count(F.when(~F.col("held_out"), 1)).alias("train_rare"),
    )


def scores(docs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Documents whose crc32 of the id modulo 10 is 0 are held out; a null id counts as an empty
    one. A null text is empty and has the end as its only token. Without training documents
    every token is unseen. Repeated rows are counted and scored each. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    words = frequent_words(rows)
    texts = encoded(rows, words)
    model, counts, documents = train(texts, len(words), classes)
    rare = stored(_rare(texts), "rare-words")
    sums = rare.agg(F.sum("new_words").alias("v"), F.sum("train_rare").alias("n")).first()
    v_rare, n_rare = int(sums["v"] or 0), int(sums["n"] or 0)
    n_train = int(counts.sum()) + n_rare + documents
    v_train = int((counts > 0).sum()) + v_rare + (documents > 0)
    inside = classes_inside(model.classes)
    n_other = int(counts[inside:].sum()) + n_rare
    v_other = int((counts[inside:] > 0).sum()) + v_rare
    base_below = float(np.log10(n_train + 0.1 * (v_train + 1)))
    other_below = float(np.log10(n_other + 0.1 * (v_other + 1)))
    model_part = spark.sparkContext.broadcast((model.flat, normalisers(spark, model), counts, documents))
    class_count = model.classes
    schema = "row long, _lm_id long, held_out boolean, n_tokens long, known long, own_rare long, log_table double, log_outside double, n_outside long, log_class double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, normaliser, count, ends = model_part.value
        own = LogBilinear(class_count)
        own.flat[:] = flat
        log_count = np.log10(count + 0.1)
        for batch in batches:
            out = []
            for numbers in batch["numbers"]:
                there = numbers[numbers >= 0]
                s = _sequence(numbers, class_count)
                log_class = 0.0
                for at in range(0, len(s) - 2, 1 << 16):  # long texts in pieces
                    piece = s[at : at + (1 << 16) + 2]
                    w1, w2, target = piece[:-2], piece[1:-1], piece[2:]
                    log_class += float((own.scores(w1, w2, target) - normaliser[w1, w2]).sum(dtype=np.float64))
                outside = there[there >= classes_inside(class_count)]
                n_absent = len(numbers) - len(there)
                out.append(
                    (
                        len(numbers) + 1,
                        int((count[there] > 0).sum()) + (ends > 0),
                        n_absent,
                        float(log_count[there].sum()) + float(np.log10(ends + 0.1)),
                        float(log_count[outside].sum()),
                        len(outside) + n_absent,
                        log_class / float(np.log(10)),
                    )
                )
            names = ["n_tokens", "known", "own_rare", "log_table", "log_outside", "n_outside", "log_class"]
            yield pd.concat(
                [batch[["row", "_lm_id", "held_out"]], pd.DataFrame(out, columns=names, index=batch.index)], axis=1
            )

    scored = texts.select("row", "_lm_id", "held_out", "numbers").mapInPandas(score, schema)
    joined = scored.join(rare, "row", "left")
    # Repeated rows share one sum; each has its part of it.
    part = F.when(F.col("own_rare") > 0, F.col("own_rare") / F.col("n_rare")).otherwise(F.lit(0.0))
    log_rare = F.coalesce(F.col("log_rare") * part, F.lit(0.0))
    return joined.select(
        doc_id(),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("known_rare") * part), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_table") + log_rare - F.col("n_tokens") * F.lit(base_below)).alias("base_score"),
        (
            F.col("log_class") + F.col("log_outside") + log_rare - F.col("n_outside") * F.lit(other_below)
        ).alias("score"),
    )


def classes_inside(classes: int) -> int:
    """Words with a class of their own."""
    return classes - 3
