"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from its place in a document by k = floor(m * rate) edits. Cut in k + 1 pieces,
one piece at least stands there unchanged. An Aho-Corasick automaton finds all pieces' exact hits; where a hit puts the
item, Myers' bit-parallel algorithm gives the smallest edit distance to any stretch of the text, and counts it up to k.

Both sides are compared in lower case, with every run of other than letters and digits as one space. Null or empty texts
and items match nothing. Long texts are read whole. Ties: of equal distances the earliest end counts. Repeated rows each get
theirs. Items are taken in chunks of about `CHUNK` characters by a hash (a longer item alone), so what is broadcast is
bounded; documents are read once for each chunk, and a worker builds a chunk's automaton once. Ids keep their types. Empty
tables give empty ones. Columns other than ids and texts are left out by `find_leaks` and pass through `without_leaks`,
whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lekhani.llm.common import small_batches, table

#: Edits for each character of an item; and characters of all items that one pass over the documents looks for.
RATE, CHUNK = 0.05, 4_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The smallest edit distance between the pattern and a stretch of the text, and where its first such stretch ends; None if over most."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full  # a stretch may start anywhere: the top row stays 0
        plus, minus = down | (full & ~(d | up)), up & d
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Items:
    """Test items made ready for search."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in ((i, normal(t)) for i, t in rows) if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, errors allowed, end of the best stretch in the normalised text)."""
        text = normal(text)
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                _, item, k = self.items[n]
                start = end + 1 - size - at
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                own = spans.setdefault(n, [])
                if own and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        out = []
        for n, own in spans.items():
            number, item, k = self.items[n]
            found = [(0, at + len(item))] if (at := text.find(item)) >= 0 else [(d, lo + e) for lo, hi in own if (hit := myers(item, text[lo:hi], k)) for d, e in [hit]]
            if found:
                distance, end = min(found)
                out.append((number, distance, k, end))
        return sorted(out)


_READY: dict[tuple, Items] = {}
#: Numbers of chunks, no two alike in a cluster's life.
_NUMBERS = (f"{uuid.uuid4().hex}" for _ in count())


def _ready(number: str, rows: list[tuple[int, str]], rate: float) -> Items:
    """A worker keeps the automaton of the chunk (a broadcast's number) that it used last."""
    if (number, rate) not in _READY:
        _READY.clear()
        _READY[number, rate] = Items(rows, rate)
    return _READY[number, rate]


def _chunks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about CHUNK characters, by their hash."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-total // CHUNK)
    for part in range(n):
        yield [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == part).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: id, item id, distance, errors_allowed, end_char (of the normalised text)."""
    types = {c: t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (items, item_id))}
    schema = f"id {types[id_col]}, item {types[item_id]}, distance int, errors_allowed int, end_char long"
    spark, out, kind = docs.sparkSession, None, to_arrow_type(items.schema[item_id].dataType)
    for rows in _chunks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=next(_NUMBERS)) -> Iterator[pa.RecordBatch]:
            wanted = _ready(number, shared.value, rate)
            for batch in small_batches(batches, 1):
                places, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = wanted.find(text)
                    places += [i] * len(hits)
                    found += hits
                item, distance, errors, end = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.record_batch([batch.column(0).take(pa.array(places, pa.int64())), pa.array(item, kind), pa.array(distance, pa.int32()), pa.array(errors, pa.int32()), pa.array(end, pa.int64())], ["id", "item", "distance", "errors_allowed", "end_char"])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without the documents that hold an item. No shuffle."""
    at = docs.columns.index(text_col)
    for rows in _chunks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=next(_NUMBERS)) -> Iterator[pa.RecordBatch]:
            wanted = _ready(number, shared.value, rate)
            for batch in small_batches(batches, at):
                clean = np.array([not wanted.find(t) for t in batch.column(at).to_pylist()], bool)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
