"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; one logistic classifier for each bit reads hashed byte 1- to 3-grams of the lower-cased
letters of the whole text. Loss-weighted decoding sums each bit's logistic loss, weighted by how well the bit was told
in training for that language, and takes the nearest codeword; if the second is nearly as near, the row is ambiguous.

Null text or one without a letter gets `und`, score 0. Without labelled rows every text gets `und`. Equal texts get equal
rows. Training takes a bounded sample: about `per_language` distinct texts of each language, chosen by a hash of
their text, and MOST_ROWS at most. Ties of languages go to the first in alphabetical order. Long texts are read whole. An empty
table gives an empty one. Columns other than id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.llm.common import id_bucket, small_batches, table, text_bytes

#: Feature slots; 12 bits of a multiplicative hash.
SLOTS_LOG2 = 12
SLOTS = 1 << SLOTS_LOG2
#: Bounds of the training sample: rows of a language, and rows in all.
PER_LANGUAGE, MOST_ROWS = 400, 8000
#: A second codeword whose loss exceeds the first's by less than this is too near.
AMBIGUOUS = 0.05
_M1, _M2, _M3 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
#: ASCII that is no letter becomes a space.
_LETTERS = np.array([b if chr(b).isalpha() or b > 127 else 32 for b in range(256)], np.uint8)


def slots(raw: np.ndarray) -> np.ndarray:
    """The slot of each 1-, 2- and 3-gram of the bytes."""
    b = raw.astype(np.uint32)
    shift = np.uint32(32 - SLOTS_LOG2)
    one = (b + np.uint32(7)) * _M1
    two = (b[:-1] * _M2 + b[1:] + np.uint32(263)) * _M1
    three = (b[:-2] * _M3 + b[1:-1] * _M2 + b[2:] + np.uint32(70001)) * _M1
    return np.concatenate([one >> shift, two >> shift, three >> shift])


def squeeze(raw: np.ndarray) -> np.ndarray:
    """Letters, runs of anything else as one space."""
    c = _LETTERS[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def vectors(column: pa.Array) -> np.ndarray:
    """One row for each text: square roots of the slots' shares, which have length 1."""
    lowered = pc.utf8_lower(column.fill_null(""))
    raw, off = text_bytes(lowered)
    out = np.zeros((len(column), SLOTS), np.float32)
    for i in range(len(column)):
        if off[i + 1] > off[i]:
            counts = np.bincount(slots(squeeze(raw[off[i] : off[i + 1]])), minlength=SLOTS)
            out[i] = np.sqrt(counts / counts.sum())
    return out


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits in two for up to 6 languages, else the best-spread of 64 seeded random codes."""
    if k <= 6:
        n = max(1, (1 << (k - 1)) - 1)
        return np.array([[1 if i == 0 or not (j + 1) >> (i - 1) & 1 else -1 for j in range(n)] for i in range(k)])
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))

    def spread(m: np.ndarray) -> int:
        return min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))

    codes = [rng.choice([-1, 1], (k, bits)) for _ in range(64)]
    return max(codes, key=spread)


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its share of exp(-loss), and whether the second is as near."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(self.trust[c] * np.logaddexp(0, -self.code[c] * margin)).sum(1) for c in range(len(self.languages))], 1)
        order = np.sort(loss, 1)
        share = np.exp(-(loss - order[:, :1]) * self.code.shape[1])
        best = loss.argmin(1)
        gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, 1 / share.sum(1), gap < AMBIGUOUS


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150) -> Model:
    """Logistic bit classifiers by accelerated gradient steps, languages weighted evenly."""
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    even = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y].astype(np.float32)
    even = (even / even.sum())[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    vw, vb, rate, ridge = np.zeros_like(w), np.zeros_like(b), 8.0, 1e-5
    for _ in range(steps):
        g = -target * even / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw - rate * (x.T @ g + ridge * w), 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    right = target * (x @ w + b) > 0
    trust = np.stack([right[y == c].mean(0) if (y == c).any() else np.ones(code.shape[1]) for c in range(len(languages))])
    return Model(languages, code, w, b, trust / trust.sum(1, keepdims=True).clip(1e-9))


def _featured(rows: DataFrame, label: str, text: str) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            yield pa.record_batch([batch.column(0), pa.array([v.astype(np.float16).tobytes() for v in vectors(batch.column(1))], pa.binary())], ["label", "x"])

    return rows.select(label, text).mapInArrow(run, "label string, x binary").collect()  # bounded: the training sample


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """None without labelled rows. The sample: rows whose text's hash lies in the share of its language that gives about per_language distinct texts."""
    labelled = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    texts = labelled.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    counts = {r["label"]: max(1, r["n"]) for r in texts.collect()}  # as many rows as languages
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, min(per_language, MOST_ROWS / len(languages)) / counts[k]))])
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("label")] * float(1 << 30)).distinct()
    drawn = drawn.orderBy(F.xxhash64("text", F.lit(1)), "label").limit(MOST_ROWS)
    rows = _featured(drawn, "label", "text")
    if not rows:
        return None
    place = {k: i for i, k in enumerate(languages)}
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return fit(x, np.array([place[r["label"]] for r in rows]), languages)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, ambiguous. Reads the text only."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x bits floats: a few hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches, 1):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in part.column(1).to_pylist()])
                if model is None:
                    names, score, near = ["und"] * len(lettered), np.zeros(len(lettered)), np.ones(len(lettered), bool)
                else:
                    best, score, near = model.decode(vectors(part.column(1)))
                    names = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0).astype(float)), pa.array(np.where(lettered, near, True))], ["id", "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(id_bucket("doc_id", 5) != 0))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
