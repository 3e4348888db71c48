"""Secret scans: fixed patterns, and a likelihood ratio of two character Markov models.

The models are first-order chains over the characters of tokens. One is trained on strings that the
fixed patterns label as secrets, the other on ordinary identifiers and words of the same corpus; a
token whose log-likelihood ratio is high is reported as a span of kind ``markov``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import arrow_map, texts_of

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs that can hold a secret. Every access or hex match of the required length lies within one.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
WORD = re.compile(r"[A-Za-z0-9_]{6,}+")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(SYMBOLS) + 1  # 0 is the edge of a token
_CODE = np.zeros(256, dtype=np.uint8)
_CODE[np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)] = np.arange(1, SIZE)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Spans (start, kind number, end) of the fixed patterns, in order, and the secret strings in them."""
    spans, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            spans.append((m.start(), 0, m.end()))
            values.append(m.group(2))
    for run in RUN.finditer(text):
        for kind, pattern, least in ((1, ACCESS, 16), (2, HEX, 32)):
            for m in pattern.finditer(text, run.start(), run.end()):
                if m.end() - m.start() >= least:
                    spans.append((m.start(), kind, m.end()))
                    values.append(m.group())
    return sorted(spans), values


def pair_counts(tokens: list[str]) -> np.ndarray:
    """Counts of character pairs, edges included, over ASCII tokens."""
    data = np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode("ascii"), dtype=np.uint8)
    codes = _CODE[data].astype(np.int32)
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def train(docs: DataFrame, *, text_col: str = "text", smooth_random: float = 30.0, smooth_ordinary: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each character pair, from all documents.

    Tasks count pairs; Spark sums them, and only the two fixed tables of pair counts reach the driver.
    Labels: strings found by the fixed patterns are random, words outside such spans are ordinary.
    Each count is smoothed towards the uniform chain, so that a corpus without secrets, or an empty
    one, still gives a defined model.
    """

    def make():
        def step(batch):
            random, ordinary = [], []
            for text in texts_of(batch.column(0)):
                spans, values = base_spans(text)
                random += values
                at = 0
                for start, _, end in [*spans, (len(text), 0, len(text))]:
                    if start > at:
                        ordinary += WORD.findall(text, at, start)
                    at = max(at, end)
            counts = [pair_counts(x) for x in (random, ordinary)]
            rows = [(label, int(p), int(c[p])) for label, c in enumerate(counts) for p in np.flatnonzero(c)]
            return {k: [r[i] for r in rows] for i, k in enumerate(("label", "pair", "n"))}

        return step

    summed = arrow_map(docs.select(text_col), make, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    table = np.zeros((2, SIZE * SIZE))
    for r in summed.collect():  # at most 2 x SIZE x SIZE rows
        table[r["label"], r["pair"]] = r["n"]
    table = table.reshape(2, SIZE, SIZE)
    table[0] += smooth_random
    table[1] += smooth_ordinary
    logs = np.log(table / table.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def log_ratio(token: str, model: np.ndarray) -> float:
    """Total log-likelihood ratio of a token's inner character pairs."""
    codes = _CODE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    return float(model[codes[:-1], codes[1:]].sum())


def find_secrets(text: str, model: np.ndarray, ratios: dict[str, float], least_mean: float, least_total: float) -> tuple[list, list]:
    """Base spans and added spans of one text. ``ratios`` caches ratios of tokens."""
    base, _ = base_spans(text)
    added = []
    at, reached = 0, 0  # the base spans come by start: those that begin before the run's end, and the farthest end of these
    for run in RUN.finditer(text):
        token = run.group()
        while at < len(base) and base[at][0] < run.end():
            reached = max(reached, base[at][2])
            at += 1
        if reached > run.start():
            continue
        ratio = ratios.get(token)
        if ratio is None:
            if len(ratios) > 200_000:
                ratios.clear()
            ratio = ratios[token] = log_ratio(token, model)
        if ratio >= least_total and ratio >= least_mean * (len(token) - 1):
            added.append((run.start(), 3, run.end()))
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(
    docs: DataFrame,
    model: np.ndarray,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_mean: float = 1.0,
    least_total: float = 20.0,
) -> DataFrame:
    """One row per input row: id, counts by kind, ``base_spans`` and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. A token is
    added as ``markov`` if its log-likelihood ratio is at least ``least_total`` and at least
    ``least_mean`` a pair, and it touches no base span. A null or empty text has no spans. Repeated
    rows each give a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, n_markov long, base_spans string, spans string"

    def make():
        ratios: dict[str, float] = {}

        def step(batch):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans")}
            for text in texts_of(batch.column(1)):
                base, added = find_secrets(text, shared.value, ratios, least_mean, least_total)
                kinds = [k for _, k, _ in base]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(kinds.count(k))
                out["n_markov"].append(len(added))
                out["base_spans"].append(joined(base))
                out["spans"].append(joined(base + added))
            return {id_col: batch.column(0), **out}

        return step

    return arrow_map(docs.select(id_col, text_col), make, schema)


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """``text`` with every span replaced; overlapping spans become one mask."""
    at, parts = 0, []
    cuts = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x))
    for start, end in cuts:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, model: np.ndarray, *, text_col: str = "text", least_mean: float = 1.0, least_total: float = 20.0) -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked; all other columns and rows stay. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator):
        import pyarrow as pa

        ratios: dict[str, float] = {}
        for batch in batches:
            texts = []
            for value in batch.column(place):
                text = value.as_py()
                if text:
                    base, added = find_secrets(text, shared.value, ratios, least_mean, least_total)
                    text = redact(text, joined(base + added))
                texts.append(text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, schema)


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
