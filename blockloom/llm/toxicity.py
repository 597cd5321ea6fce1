"""Toxicity: a convolutional text classifier, trained in numpy.

Words and their first letters are hashed into one embedding table; filters of several widths run over the whole text and
the largest response of each is what the output layer sees. The decision threshold is calibrated by language, which is
guessed from the function words of the text: all labelled rows that the filters have not learned from are scored where
they lie and counted by language, label and margin.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import give_back, held_out, remembered, table, tidy
from .learning import keep_rows, label_of, sample_texts

#: Labelled rows that are learned from at most.
SAMPLE_ROWS = 8_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 19, 8, (1, 2, 3), 12
EPOCHS, RATE, BATCH, PREFIX = 5, 0.05, 16, 4
#: Rows of a language's rarer label that put its threshold half-way between the common one and its own best.
HALF_WAY = 12
#: Margins are counted in bins of this width, out to LIMIT on both sides.
BIN, LIMIT = 0.02, 30.0
#: Words that a worker remembers at most; the memory is emptied when it is full.
REMEMBER = 50_000

_WORD = re.compile(r"[^\W\d_]+")
#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as be by this are from or an".split(),
    "de": "der die das und zu den von mit ist des dem nicht ein eine auf für im sich auch".split(),
    "fr": "le les et des du une est que qui dans pour par sur au pas avec ce il elle".split(),
    "es": "el los las y del se por con para una su al lo como más pero sus este es".split(),
}
_LANGUAGE = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}


def _entry(word: str) -> tuple[int, int, int]:
    return zlib.crc32(b"w" + word.encode()) % BUCKETS, zlib.crc32(b"p" + word[:PREFIX].encode()) % BUCKETS, _LANGUAGE.get(word, -1)


def words_of(text: bytes) -> tuple[np.ndarray, int]:
    """(2, number of words) buckets, and the number of the language whose function words are most."""
    words = _WORD.findall(text.decode("utf-8", "replace").lower())
    known = remembered("toxicity")
    if len(known) > REMEMBER:
        known.clear()
    try:
        got = [known[w] for w in words]
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = _entry(w)
        got = [known[w] for w in words]
    if not got:
        return np.zeros((2, 0), dtype=np.int64), -1
    a = np.array(got, dtype=np.int64).T
    spoken = a[2][a[2] >= 0]
    return a[:2], int(np.bincount(spoken).argmax()) if len(spoken) else -1


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[int, float] = field(default_factory=dict)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        pad = np.zeros((max(WIDTHS) - 1, DIM), dtype=np.float32)  # a text shorter than a filter, or none at all
        x = self.table[ids[0]].astype(np.float32)
        x += self.table[ids[1]]
        return np.concatenate([x, pad]) if len(x) else np.concatenate([pad, np.zeros((1, DIM), dtype=np.float32)])

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        most, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = len(x) - w + 1
            r = x[:n] @ f[0]
            for j in range(1, w):
                r += x[j : j + n] @ f[j]
            at = r.argmax(axis=0)
            where.append(at)
            most.append(r[at, np.arange(FILTERS)] + b)
        return np.concatenate(most), where

    def margin(self, ids: np.ndarray) -> float:
        return float(np.maximum(self.pooled(self.embed(ids))[0], 0) @ self.out + self.base)

    def score(self, margin: float, language: int) -> float:
        """Over 0.5 from the language's threshold on."""
        return float(1 / (1 + np.exp(-np.clip(margin - self.thresholds.get(language, self.thresholds.get(-2, 0.0)), -30, 30))))


def _threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """Half-way across the widest of the gaps where the fewest rows are on the wrong side. Rows are counted by intervals of
    margins, a single row being an interval of its own; those that overlap are taken together."""
    order = np.lexsort((high, low))
    low, high, toxic, clean = low[order], high[order], toxic[order], clean[order]
    at = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]])
    low, high, toxic, clean = low[at], np.maximum.reduceat(high, at), np.add.reduceat(toxic, at), np.add.reduceat(clean, at)
    wrong = np.r_[0, np.cumsum(toxic)] + np.r_[clean[::-1].cumsum()[::-1], 0]  # below: toxic, from there on: not toxic
    edge = np.r_[low[0] - 1, (low[1:] + high[:-1]) / 2, high[-1] + 1]
    gap = np.r_[1, low[1:] - high[:-1], 1]
    best = np.flatnonzero(wrong == wrong.min())
    return float(edge[best[gap[best].argmax()]])


def thresholds_of(language: np.ndarray, low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> dict[int, float]:
    """-2: the common threshold; and one of each language that has rows of both labels, drawn to the common one the more
    the fewer rows its rarer label has. Empty if there are no rows of both labels at all."""
    if not toxic.sum() or not clean.sum():
        return {}
    out = {-2: _threshold(low, high, toxic, clean)}
    for lang in range(len(FUNCTION_WORDS)):
        own = language == lang
        if n := min(toxic[own].sum(), clean[own].sum()):
            out[lang] = out[-2] + float(n / (n + HALF_WAY)) * (_threshold(low[own], high[own], toxic[own], clean[own]) - out[-2])
    return out


def fit(seen: list[tuple[np.ndarray, int]], toxic: np.ndarray, apart: np.ndarray, seed: int = 5) -> Net:
    """seen: buckets and language of each text; apart: rows that are kept from the filters. Adagrad over batches; the rows apart set the thresholds. Without both labels
    every score is the smoothed share of toxic rows."""
    r = np.random.default_rng(seed)
    net = Net(
        r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), [r.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) / w for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -2.0,
    )
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    if len(toxic) < 5 or toxic.min() == toxic.max():
        net.out[:] = 0
        net.base = float(np.log(share / (1 - share)))
        net.thresholds = {-2: 0.0}
        return net
    use = np.flatnonzero(~apart)
    weight = np.where(toxic > 0, min(8.0, (1 - share) / share), 1.0)
    dense = [*net.filters, *net.bias, net.out]
    power, rows_power, base_power = [np.full_like(d, 1e-3) for d in dense], np.full(BUCKETS, 1e-3, dtype=np.float32), 1e-3
    k = len(WIDTHS)
    for _ in range(EPOCHS):
        r.shuffle(use)
        for start in range(0, len(use), BATCH):
            grads, base_grad = [np.zeros_like(d) for d in dense], 0.0
            rows, row_grads = [], []
            for i in use[start : start + BATCH]:
                ids = seen[i][0]
                x = net.embed(ids)
                most, where = net.pooled(x)
                on = most > 0
                z = np.maximum(most, 0) @ net.out + net.base
                g = float(weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[i]))
                if abs(g) < 1e-3:
                    continue
                base_grad += g
                grads[-1] += g * np.maximum(most, 0)
                back = (g * net.out * on).reshape(k, FILTERS)
                for a, w in enumerate(WIDTHS):
                    grads[k + a] += back[a]
                    for j in range(w):
                        at = where[a] + j
                        grads[a][j] += x[at].T * back[a]
                        real = (at < ids.shape[1]) & (back[a] != 0)
                        if real.any():
                            d = (net.filters[a][j] * back[a]).T[real]
                            rows += [ids[0][at[real]], ids[1][at[real]]]
                            row_grads += [d, d]
            for d, g, p in zip(dense, grads, power):
                p += g * g
                d -= RATE * g / np.sqrt(p)
            base_power += base_grad**2
            net.base -= RATE * base_grad / base_power**0.5
            if rows:
                ids, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                g = np.zeros((len(ids), DIM), dtype=np.float32)
                np.add.at(g, inverse, np.concatenate(row_grads))
                rows_power[ids] += (g * g).mean(axis=1)
                net.table[ids] -= 4 * RATE * g / np.sqrt(rows_power[ids])[:, None]
    margin = np.array([net.margin(s[0]) for s in seen])
    y = toxic.astype(np.int64)
    held = apart if y[apart].sum() and (1 - y[apart]).sum() else np.ones(len(y), dtype=bool)
    language = np.array([s[1] for s in seen])
    net.thresholds = thresholds_of(language[held], margin[held], margin[held], y[held], 1 - y[held])
    net.table = net.table.astype(np.float16)
    return net


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """A net from the labelled rows outside the held-out fifth, at most ``rows`` of them; all others calibrate it."""

    def measure(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            seen = [words_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array([x[0].astype(np.int32).tobytes() for x in seen], pa.binary()), pa.array([x[1] for x in seen], pa.int32()), pa.array([zlib.crc32(t) % 5 == 0 for t in texts])],
                names=["id", "label", "words", "language", "apart"],
            )

    texts = sample_texts(docs, labels, column, rows, id_col, text_col).select("id", "label", "text")
    kind = texts.schema["id"].dataType.simpleString()
    got = texts.mapInArrow(tidy(measure), f"id {kind}, label double, words binary, language int, apart boolean").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    # The words stay where Arrow has them: for long texts they are by far the most of what the driver holds.
    words = [np.frombuffer(w.as_buffer() or b"", dtype=np.int32).reshape(2, -1) for w in got["words"]]
    language = got["language"].to_numpy()
    seen = [(words[i], int(language[i])) for i in order]
    label, apart = got["label"].to_numpy()[order], got["apart"].to_numpy()[order]
    net = fit(seen, (label >= 0.5).astype(np.float64), apart.astype(bool))
    learned = got.select(["id"]).filter(pa.compute.invert(got["apart"]))
    del got, words, seen
    give_back()
    if net.out.any():
        calibrate(net, docs, labels, learned, column, id_col, text_col)
    return net


def calibrate(net: Net, docs: DataFrame, labels: DataFrame, learned: pa.Table, column: str, id_col: str, text_col: str) -> None:
    """Set the thresholds by all labelled rows outside the held-out fifth, without those the filters learned from (their
    ids, of a bounded number). Every document is scored where it lies, and only its id, language and margin are joined
    to the labels; what comes to the driver is counts by language and bin. Without rows of both labels the thresholds
    stay those of the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    texts = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def measure(batches):
        for b in batches:
            seen = [words_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[1] for x in seen], pa.int32()), pa.array([shared.value.margin(x[0]) for x in seen], pa.float64())], names=["id", "language", "margin"])

    margins = texts.mapInArrow(tidy(measure), f"id {texts.schema['id'].dataType.simpleString()}, language int, margin double")
    known = label_of(labels, column, id_col).join(F.broadcast(docs.sparkSession.createDataFrame(learned)), "id", "left_anti")
    place = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("margin"))) / BIN)
    toxic = F.sum((F.col("label") >= 0.5).cast("long"))
    counted = margins.join(known, "id").groupBy("language", place.alias("bin")).agg(F.min("margin").alias("low"), F.max("margin").alias("high"), toxic.alias("toxic"), (F.count("*") - toxic).alias("clean")).toArrow()
    net.thresholds |= thresholds_of(*(counted[c].to_numpy() for c in ("language", "low", "high", "toxic", "clean")))
    shared.destroy()


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        ids, language = words_of(t)
        out[i] = net.score(net.margin(ids), language)
    return out


def score_toxicity(docs: DataFrame, model: Net, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, held_out, score, predicted.

    A null text counts as empty and has a score too. Null ids are not held out. Rows that repeat are scored each; an
    empty table gives an empty result, and columns other than the text don't matter to the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS times DIM
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            s = scores(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return slim.mapInArrow(tidy(run), f"`{id_col}` {slim.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Net, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score_toxicity would predict 0 for, as they are; see keep_rows."""
    return keep_rows(docs, model, scores, lambda s: s < threshold, text_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
