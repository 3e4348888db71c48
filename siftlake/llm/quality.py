"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, numpy SGD.

A word's vector is the mean of the learned vectors of its hashed form and its hashed character
n-grams. A document's vector is the mean over its words; a softmax layer turns it into classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, texts_of


@dataclass(frozen=True)
class Settings:
    """``buckets`` x ``dim`` bounds the model; ``sample_rows`` of at most ``sample_chars`` each, and ``steps``, bound the fit."""

    buckets: int = 1 << 16
    dim: int = 12
    shortest: int = 2
    longest: int = 4
    steps: int = 8000
    epochs_most: int = 40
    rate: float = 0.4
    sample_rows: int = 1600
    sample_chars: int = 8000
    seed: int = 11


CHUNK_CHARS = 200_000
#: Stands for a repeated word, so that repetition has a vector of its own whatever the word is.
REPEAT = "\x01"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def chunks(text: str) -> Iterator[list[str]]:
    """The words of a text in runs of bounded length; a word like the one before it becomes ``REPEAT``."""
    words = text.split()
    words = [REPEAT if w == v else w for v, w in zip([None, *words], words, strict=False)]
    if len(text) <= CHUNK_CHARS:
        if words:
            yield words
        return
    at, size = 0, 0
    for k, word in enumerate(words):
        size += len(word)
        if size >= CHUNK_CHARS:
            yield words[at : k + 1]
            at, size = k + 1, 0
    if at < len(words):
        yield words[at:]


def features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams (``<`` and ``>`` mark a word's ends), and whose they are."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    powers = np.multiply.accumulate(np.full(lengths.max(), _MIX[0]))
    whole = np.add.reduceat(codes * powers[np.arange(len(codes)) - starts[of]], starts)
    hashes, owners = [whole ^ (whole >> np.uint64(29))], [np.arange(len(words))]
    for n in range(s.shortest, s.longest + 1):
        if len(codes) < n:
            break
        inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
        mixed = np.full(len(inside), n * 0x1F35 + s.seed, dtype=np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[inside + k]) * _MIX[1 + k % 4]
        hashes.append(mixed)
        owners.append(of[inside])
    mixed = np.concatenate(hashes) * _MIX[2]
    return ((mixed >> np.uint64(33)) % np.uint64(s.buckets)).astype(np.int64), np.concatenate(owners)


def weights(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which sum to 1 (none for a text without words)."""
    parts, total = [], 0
    for words in chunks(text):
        buckets, owners = features(words, s)
        parts.append((buckets, 1.0 / np.bincount(owners)[owners]))
        total += len(words)
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    distinct, place = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate([w for _, w in parts])) / total


@dataclass(frozen=True)
class QualityModel:
    settings: Settings
    vectors: np.ndarray  # buckets x dim
    layer: np.ndarray  # classes x dim
    bias: np.ndarray


def fit_rows(rows: list[tuple[str, int]], s: Settings) -> QualityModel:
    """Stochastic gradient descent, one document a step, the rate falling to zero over ``steps`` (few rows: ``epochs_most`` passes)."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    layer = np.zeros((2, s.dim), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    inputs = [(*weights(t, s), y) for t, y in rows]
    inputs = [(b, w.astype(np.float32), y) for b, w, y in inputs if len(b)]
    counts = np.bincount([y for _, _, y in inputs], minlength=2) if inputs else np.zeros(2)
    if not counts.all():  # one class, or none: a constant with one pseudo row for each class
        share = (counts + 1) / (counts.sum() + 2)
        return QualityModel(s, np.zeros_like(vectors), layer, np.log(share).astype(np.float32))
    done, steps = 0, min(s.steps, s.epochs_most * len(inputs))
    while done < steps:
        for k in rng.permutation(len(inputs))[: steps - done]:
            b, w, y = inputs[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            hidden = w @ vectors[b]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = p @ layer
            layer -= rate * np.outer(p, hidden)
            bias -= rate * p
            # A bucket's share of the mean is tiny; scaled by the largest one so that the vectors learn.
            vectors[b] -= (rate * (w / w.max()))[:, None] * grad
    return QualityModel(s, vectors, layer, bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings | None = None,
) -> QualityModel:
    """A model from a bounded sample of labelled rows.

    The ``sample_rows`` labelled rows that come first by a hash of their id, among texts of up to
    ``sample_chars`` characters (a longer text is no training row), reach the driver, which trains
    there. Rows with a null id, text or label, or a label other than 0 and 1, take no part; of several texts or
    labels of one id the least by hash counts. If only one class, or none, is left, the score is a constant.
    """
    s = settings or Settings()
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    rows = (
        docs.where(usable if usable is not None else F.lit(True))
        .select(id_col, F.col(text_col).alias("_t"))
        .where(F.col("_t").isNotNull() & (F.length("_t") <= s.sample_chars))
    )
    keys = rows.select(id_col).join(marked.hint("merge"), id_col)
    first = keys.select(id_col, "_y").distinct().orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col, "_y").limit(s.sample_rows)
    chosen = {}
    for r in first.collect():  # sample_rows keys
        chosen.setdefault(r[0], r[1])
    asked = rows.where(F.col(id_col).isin(list(chosen)))  # one text an id, however often the id repeats
    texts = {r[0]: r[1] for r in asked.groupBy(id_col).agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t"))).collect()} if chosen else {}
    return fit_rows([(texts[i], y) for i, y in chosen.items()], s)


class Scorer:
    """Scores texts. With two classes the softmax needs but one number a bucket: the difference of the outputs.

    Words' numbers are kept (at most ``most``), so that a word is hashed once.
    """

    def __init__(self, model: QualityModel, most: int = 400_000) -> None:
        self.settings, self.most = model.settings, most
        self.value = (model.vectors @ (model.layer[1] - model.layer[0])).astype(np.float64)
        self.bias = float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def __call__(self, text: str) -> float:
        known, total, n = self.known, 0.0, 0
        for words in chunks(text):
            new = list(set(words).difference(known))
            if new:
                if len(known) + len(new) > self.most:
                    known.clear()
                    new = list(set(words))
                buckets, owners = features(new, self.settings)
                known.update(zip(new, (np.bincount(owners, self.value[buckets]) / np.bincount(owners)).tolist(), strict=True))
            total += math.fsum(map(known.__getitem__, words))
            n += len(words)
        z = self.bias + (total / n if n else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` (1 if score >= ``threshold``).

    The whole text is used. A null, empty or blank text gets the model's score for no words at all.
    Repeated rows each give a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, score double, predicted int"

    def make():
        scorer = Scorer(shared.value)

        def step(batch):
            got = [scorer(t) for t in texts_of(batch.column(1))]
            return {id_col: batch.column(0), "score": got, "predicted": [int(x >= threshold) for x in got]}

        return step

    return arrow_map(docs.select(id_col, text_col), make, schema)
