"""Quality classification by Bradley-Terry pairwise ranking.

A document's latent score is linear in features of its text's surface. The weights come from preference pairs (a row of
label 1 over one of label 0) by logistic loss on the difference of their features: every labelled row of one label is held
against every one of the other. A pair's loss depends on the two scores only, so the scores' distributions, on nodes with
weights linear between them, stand for the pairs, and no pair is made. Latent scores become 0 to 1 by a logistic curve that
puts a quantile of all training rows' scores, the share of label 0, at the threshold.

Null and empty texts have features of zero and a score. Without pairs every score is the threshold itself. Ties get equal
scores. Up to `TRAIN_ROWS` rows of each label, chosen by a hash of their features (18 numbers a row: 2 MB in all), give the
weights that the descent over all rows begins with; the loss is convex, so where it ends doesn't hang on them. Long texts are read whole. An empty table gives an empty one. Columns other than id and text
are left out, whatever their names; `without_rejected` returns all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.llm.common import LOWER, NOT_BLANK, discard, id_bucket, settle, small_batches, span_hashes, table, text_bytes, word_spans

THRESHOLD = 0.7
#: Bounds of what gives the first weights: rows of a label, and preference pairs.
TRAIN_ROWS, PAIRS = 6000, 60_000
#: Spaces between the nodes of the scores' distributions, weight of the squared weights, largest slope left at the end, most steps.
SPACES, RIDGE, SLOPE, STEPS = 4096, 1e-3, 1e-5, 40
#: Parts that one pass cuts a range of scores into, when a quantile is sought.
CUTS = 4096
FEATURES = ["length", "short", "upper", "digit", "mark", "bang", "bar", "odd", "newline", "word_length", "word_spread", "marked_words", "upper_words", "repeated", "distinct", "top_word", "small_words", "line_words"]

_B = np.arange(256)
_UPPER, _LETTER = (_B >= 65) & (_B <= 90), ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B > 127)
_DIGIT = (_B >= 48) & (_B <= 57)
_MARK = ~_LETTER & ~_DIGIT & NOT_BLANK & (_B >= 32) & (_B != ord(".")) & (_B != ord(","))


def _share(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[off[1:]] - total[off[:-1]]) / np.maximum(off[1:] - off[:-1], 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, off = text_bytes(column)
    n = len(column)
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    size = off[1:] - off[:-1]
    starts, ends, first = word_spans(raw, off, NOT_BLANK)
    lengths = (ends - starts).astype(float)
    hashes = span_hashes(LOWER[raw], starts, ends)
    words = np.maximum(first[1:] - first[:-1], 1)
    mean = _share(lengths, first)
    marks = np.concatenate([[0], np.cumsum(_MARK[raw])])
    letters, uppers = np.concatenate([[0], np.cumsum(_LETTER[raw])]), np.concatenate([[0], np.cumsum(_UPPER[raw])])
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    distinct, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        if first[i + 1] > first[i]:
            _, c = np.unique(hashes[first[i] : first[i + 1]], return_counts=True)
            distinct[i], top[i] = len(c), c.max()
    columns = {
        "length": np.log1p(size), "short": size < 60, "upper": _share(_UPPER[raw], off), "digit": _share(_DIGIT[raw], off), "mark": _share(_MARK[raw], off),
        "bang": _share(raw == ord("!"), off), "bar": _share(raw == ord("|"), off), "odd": _share(np.isin(raw, np.frombuffer(b"#$%&*<>{}[]\\^~_=", np.uint8)), off), "newline": _share(raw == 10, off),
        "word_length": mean, "word_spread": np.sqrt(np.maximum(_share(lengths**2, first) - mean**2, 0)), "marked_words": _share(marks[ends] - marks[starts] > 1, first),
        "upper_words": _share((uppers[ends] - uppers[starts] > 1) & (uppers[ends] - uppers[starts] >= 0.6 * (letters[ends] - letters[starts])), first),
        "repeated": _share(same, first), "distinct": np.log1p(distinct) / np.log1p(words), "top_word": top / words, "small_words": _share(lengths <= 3, first), "line_words": np.log1p(words / (1 + _share(raw == 10, off) * size)),
    }
    for k, name in enumerate(FEATURES):
        out[:, k] = np.where(size > 0, columns[name], 0)
    return out


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, x (array of the features)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            x = features(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), lists], ["id", "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, x array<double>").withColumnRenamed("id", id_col)


def expand(x: np.ndarray) -> np.ndarray:
    """The features, squared and stepped ones too, so that a linear score can bend."""
    return np.concatenate([x, x**2, np.sqrt(np.abs(x)), x[:, 2:8] > 0.02, x[:, 11:14] > 0.1], 1)


class Model:
    """Latent score = bias + sum of weights over the expanded, standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.latent(x) - self.cut) * self.slope + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def between(ordered: np.ndarray, below: int) -> float:
    """A cut with so many values below it, midway to the next."""
    k = min(max(below, 1), len(ordered) - 1)
    return float((ordered[k - 1] + ordered[k]) / 2)


def fit(good: np.ndarray, bad: np.ndarray, steps: int = 300) -> Model:
    """Bradley-Terry by gradient steps over seeded pairs; every row of the rarer label meets many of the other."""
    x = expand(np.concatenate([good, bad])) if len(good) + len(bad) else expand(np.zeros((1, len(FEATURES))))
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(11)
    n = min(PAIRS, 20 * (len(good) + len(bad)))
    d = z[rng.integers(0, len(good), n)] - z[len(good) + rng.integers(0, len(bad), n)]
    w, v = np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for _ in range(steps):
        g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) + 1e-3 * w
        v = 0.9 * v - 0.05 * g
        w = w + v
    s = z @ w
    cut = between(np.sort(s), len(bad))
    return Model(mean, scale, w, cut, 1.0)


def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(features, labels), a vector, over all batches of rows (x, label). Tasks return one vector each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(np.asarray(batch.column(0).flatten()).reshape(-1, len(FEATURES)), np.asarray(batch.column(1)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    sums = rows.select("x", "label").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(sums, key=lambda r: r["k"])])


def spread(s: np.ndarray, reach: float) -> np.ndarray:
    """The weight of scores at each node of -reach to reach, shared by the two nodes around a score."""
    at = (s + reach) * (SPACES / (2 * reach))
    low = np.clip(np.floor(at).astype(int), 0, SPACES - 1)
    return np.bincount(low, 1 - (at - low), SPACES + 1) + np.bincount(low + 1, at - low, SPACES + 1)


def descend(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights of least loss over all pairs of a row of label 1 and one of label 0. rows: x, label (both occur)."""

    def standard(x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - mean) / scale, -8, 8)

    def distributions(w: np.ndarray, reach: float) -> list[np.ndarray]:
        both = summed(rows, lambda x, label: np.concatenate([spread(s[label == k], reach) for s in [standard(x) @ w] for k in (1, 0)]))
        return [h / h.sum() for h in (both[: SPACES + 1], both[SPACES + 1 :])]

    def slopes(w: np.ndarray, reach: float, tables: dict) -> np.ndarray:
        nodes = np.linspace(-reach, reach, SPACES + 1)

        def part(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            out, z = [], standard(x)
            for k in (1, 0):
                own = z[label == k]
                first, second = (np.interp(own @ w, nodes, t) for t in tables[k])
                out += [[len(own)], first @ own, second @ own, [second.sum()], ((own * second[:, None]).T @ own).ravel()]
            return np.concatenate(out)

        return summed(rows, part)

    d, w, step, least, previous = len(weights), weights, np.zeros(len(weights)), np.inf, weights
    for _ in range(STEPS):
        reach = max(8 * float(np.abs(w).sum()), 1.0)
        good, bad = distributions(w, reach)
        apart = np.linspace(-2 * reach, 2 * reach, 2 * SPACES + 1)
        lost = 1 / (1 + np.exp(-np.clip(apart, -700, 700)))  # chance that the lower row is preferred
        mean_over = lambda kernel, h: np.correlate(kernel, h, "valid")[::-1]
        loss = good @ mean_over(np.logaddexp(0, apart), bad) + RIDGE / 2 * w @ w
        if loss > least + 1e-9:
            step = step / 2
            w = previous + step
            continue
        bend = lost * (1 - lost)
        sums = slopes(w, reach, {1: (mean_over(lost, bad), mean_over(bend, bad)), 0: (mean_over(lost[::-1], good), mean_over(bend, good))})
        up, down = ((v[1 : d + 1] / v[0], v[d + 1 : 2 * d + 1] / v[0], v[2 * d + 1] / v[0], v[2 * d + 2 :].reshape(d, d) / v[0]) for v in np.split(sums, 2))
        slope = down[0] - up[0] + RIDGE * w
        if np.abs(slope).max() < SLOPE:
            break
        # The products of the two rows of a pair are taken as if their weights were independent: the matrix stays positive.
        across = np.outer(up[1], down[1]) / max(up[2], 1e-300)
        step, least, previous = -np.linalg.solve(up[3] + down[3] - across - across.T + RIDGE * np.eye(d), slope), loss, w
        w = previous + step
    return w


def quantile(values: DataFrame, below: int) -> float:
    """The cut of `between` over all values (column s), by passes that each narrow the range; all that is collected is CUTS rows."""
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("*")).first()
    k = min(max(below, 1), n - 1)
    rest = values
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / (high - low) * CUTS), F.lit(CUTS - 1))
        parts = sorted(rest.groupBy(at.alias("at")).agg(F.count("*").alias("m"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        for i, part in enumerate(parts):
            if k <= part["m"]:
                break
            k -= part["m"]
        if k == part["m"] and i + 1 < len(parts):
            return (part["high"] + parts[i + 1]["low"]) / 2
        low, high = part["low"], part["high"]
        rest = values.where(F.col("s").between(low, high))
    return float(low)


def train(rows: DataFrame) -> Model:
    """rows: x, label (0 or 1; others are left out)."""
    rows = settle(rows.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label")))
    order = F.xxhash64("x")
    drawn = [np.array([r["x"] for r in rows.where(F.col("label") == k).orderBy(order).limit(TRAIN_ROWS).select("x").collect()]).reshape(-1, len(FEATURES)) for k in (1, 0)]
    model = fit(*drawn)
    if all(len(d) for d in drawn):
        sums = summed(rows, lambda x, label: np.concatenate([[len(x), (label == 0).sum()], expand(x).sum(0)]))
        mean = sums[2:] / sums[0]
        scale = np.sqrt(summed(rows, lambda x, _: ((expand(x) - mean) ** 2).sum(0)) / sums[0])
        scale[scale < 1e-9] = 1
        model = Model(mean, scale, descend(rows, mean, scale, model.weights * scale / model.scale), 0.0, 1.0)
        first = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array(first.latent(np.asarray(batch.column(0).flatten()).reshape(-1, len(FEATURES))))], ["s"])

        values = settle(rows.select("x").mapInArrow(run, "s double"))
        model = Model(mean, scale, first.weights, quantile(values, int(sums[1])), 1.0)
        discard(values)
    discard(rows)
    return model


def scored(rows: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, score, predicted."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES)))
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    return rows.select(id_col, "x").mapInArrow(run, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def _learnt(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """The settled features of docs, and the model that all rows of labels give."""
    rows = settle(featured(docs))
    return rows, train(rows.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality, of which all rows are learnt from. Per row of docs: doc_id, score, predicted."""
    return scored(*_learnt(docs, labels))


def without_rejected(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose own text scores under the threshold. Texts are not shuffled."""
    rows, model = _learnt(docs.select("doc_id", F.col(text_col).alias("text")), labels)
    discard(rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 4) != 2)
    out = rate(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
