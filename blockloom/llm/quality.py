"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete and flattened into arrays, so a batch of documents goes down all of them level by level in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, table, tidy
from .learning import keep_rows, sample_texts

#: Labelled rows that are learned from at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, PENALTY, LEAST = 60, 4, 64, 0.2, 1.0, 5.0

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~<>=+_\\/{}[]",
    "quote": b"'\"()-",
    "wide": range(128, 256),
    "control": [*range(9), *range(14, 32), 127],
}
_MASK = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _MASK[list(_v), _k] = 1
_SHOUTED = re.compile(rb"\b[A-Z]{2,}\b")
NAMES = [*_CLASSES, "bytes", "words", "word_length", "word_spread", "distinct_words", "top_word", "distinct_pairs", "lines", "line_words", "distinct_lines", "repeated_lines", "short_lines", "ended_lines", "shouted_words", "glued_marks", "white", "entropy"]


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole text in UTF-8; all are 0 for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = count @ _MASK / n
    words = text.split()
    m = max(1, len(words))
    each = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(lines)
    k = max(1, len(lines))
    p = count[count > 0] / n
    return [
        *share,
        np.log1p(n),
        np.log1p(len(words)),
        each.mean(),
        each.std(),
        len(often) / m,
        max(often.values(), default=0) / m,
        len(set(zip(words, words[1:]))) / m,
        np.log1p(len(lines)),
        np.log1p(m / k),
        len(seen) / k,
        sum(len(x) * (c - 1) for x, c in seen.items()) / n,
        sum(len(x) < 40 for x in lines) / k,
        sum(x.rstrip()[-1:] in b".!?:" for x in lines) / k,
        len(_SHOUTED.findall(text)) / m,
        sum(text.count(x) for x in (b"!! ", b"### ", b"$$$ ", b"%%% ", b"&&& ", b"*** ", b" | ")) / m,
        (n - each.sum()) / n,
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Trees:
    """feature and threshold by tree and inner node, value by tree and leaf; base is the log odds before any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner] if len(x) else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic loss, Newton steps, BINS quantile bins a feature. Without rows, or with one label only, the smoothed share
    of the label is every score."""
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(feature, threshold, value, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    wide = BINS + 1
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                code = local * wide + bins[:, j]
                gs = np.bincount(code, g, nodes * wide).reshape(nodes, wide).cumsum(axis=1)
                hs = np.bincount(code, h, nodes * wide).reshape(nodes, wide).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + PENALTY) + (ga - gs) ** 2 / (ha - hs + PENALTY) - ga**2 / (ha + PENALTY)
                gain[(hs < LEAST) | (ha - hs < LEAST)] = 0
                gain = gain[:, : len(e)]
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better] = top[better]
                ids = first + np.flatnonzero(better)
                feature[t, ids], threshold[t, ids] = j, e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + PENALTY)
        margin += value[t, leaf]
    return Trees(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from the labelled rows outside the held-out fifth, at most ``rows`` of them."""

    def measure(batches):
        for b in batches:
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "x"])

    texts = sample_texts(docs, labels, column, rows, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    got: pd.DataFrame = texts.select("id", "label", "text").mapInArrow(tidy(measure), f"id {kind}, label double, x array<double>").toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(NAMES))
    return fit(x, (got["label"].to_numpy() >= 0.5).astype(np.float64))


def scores(model: Trees, texts: list[bytes]) -> np.ndarray:
    return model.score(np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES)))


def score_quality(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, held_out, score, predicted.

    A null text counts as empty and has a score too. Null ids are not held out. Rows that repeat are scored each; an
    empty table gives an empty result, and columns other than the text don't matter to the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: TREES times 2 ** DEPTH
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            s = scores(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return slim.mapInArrow(tidy(run), f"`{id_col}` {slim.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score_quality would predict 1 for, as they are; see keep_rows."""
    return keep_rows(docs, model, scores, lambda s: s >= threshold, text_col)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
