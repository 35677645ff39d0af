"""Near-duplicate documents by SetSketch registers over word shingles.

A register is the truncated exponent of the smallest of exponential values, one for each shingle: floor(1 - log_b(min)),
cut to 0..Q+1. Registers of a union are the larger of each, so sketches merge. Equal texts' sets are collapsed first.
Bands of registers gather candidates; for a pair the counts of larger, smaller and equal registers give the most likely
Jaccard similarity; clearly unlike pairs go, the others are confirmed on their full sets. Links form components.

Null or empty text: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence is one shingle.
Long texts are handled whole, in slices. Ties: the smallest id represents a component. Repeated ids with equal texts count as
one; ids should tell different texts apart: where one has several, a link of any of them may count for all. Null ids are left out of links. Ids keep their type. An empty table gives an
empty one. Columns other than id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lekhani.llm.common import LOWER, NOT_BLANK, discard, mix, settle, small_batches, span_hashes, table, text_bytes, word_spans
from lekhani.llm.linking import centered, in_blocks, link

#: Bands of rows: at similarity 0.85 one of 28 bands of 4 is equal but for one pair in 10^9, at 0.8 in 4 * 10^6.
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
#: Base, rate and largest exponent of the registers. The base is near 1, so that equal registers are about as rare as equal minima.
BASE, RATE, LARGEST = 1.02, 20.0, 4000
#: A pair goes unconfirmed only if its likeliest similarity is this many standard errors under the threshold.
MARGIN = 5.0
#: Documents and shingles of a part of a pool; two parts meet in a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Bits of the filter that keeps the sets of documents without a candidate from being written.
FILTER_LOG2 = 24

_RNG = np.random.default_rng(2024)
_FACTORS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of k words; A-Z lower-cased."""
    raw, off = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, off, NOT_BLANK)
    h = span_hashes(raw, starts, ends)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled[: n - j] = mix(rolled[: n - j] * _STEP[0] + h[j:] + np.uint64(j + 1))
    out = []
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for j in range(a, b):
                whole = mix(whole * _STEP[1] + h[j : j + 1])
            out.append(whole + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set, as 16-bit integers."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[at : at + 2048, None] ^ _MASKS) * _FACTORS).min(0), out=low)
    smallest = -np.log1p(-np.minimum((low >> np.uint64(11)) / 2.0**53, 1 - 2.0**-53)) / RATE
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_jaccard(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The similarity that makes the counts of equal, larger and smaller registers likeliest, of a fine grid, given the sets' sizes.

    With u = share of the union only in a, v = only in b: P(a's register larger) = p(u - vJ'), as for SetSketch, with
    p(x) = -log_b(1 - x (b - 1) / b); that of equal is the rest.
    """
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 201)[None, :]
    grid = np.minimum(grid, np.minimum(u / v, v / u))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = np.clip(p(u - v * grid), 1e-9, 1), np.clip(p(v - u * grid), 1e-9, 1)
    same = np.clip(1 - more - less, 1e-9, 1)
    like = up[:, None] * np.log(more) + down[:, None] * np.log(less) + equal[:, None] * np.log(same)
    return grid[np.arange(len(like)), like.argmax(1)]


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, k1 and k2 (a 128-bit digest of the set), registers (null for an empty set)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            sets = shingle_sets(batch.column(1), k)
            n = [len(s) for s in sets]
            k1 = np.array([(mix(s) ^ _STEP[0]).sum(dtype=np.uint64) for s in sets]).astype(np.int64)
            k2 = np.array([mix(s * _STEP[1] + _STEP[2]).sum(dtype=np.uint64) for s in sets]).astype(np.int64)
            made = [registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(made, pa.binary())], ["id", "n_shingles", "k1", "k2", "registers"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_shingles long, k1 long, k2 long, registers binary")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_LOG2 bits, one for each id's hash: 2 MB, however many ids there are. It lets all of them pass, and some others."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_LOG2))
    rows = ids.select(F.floor(at / 32768).cast("int").alias("block"), F.pmod(at, F.lit(32768)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << FILTER_LOG2) // 32768 * 4096, np.uint8)
    for r in rows.collect():  # 4 KB for each of 2 ** FILTER_LOG2 / 32768 blocks at most
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def full_sets(docs: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """docs: id, text. ids: id. Per row of docs whose id may be among ids: id, set (the sorted hashes, 8 bytes each). Texts are not shuffled."""
    id_type = docs.schema["id"].dataType.simpleString()
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            at = np.asarray(batch.column(2))
            batch = batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], ["id", "set"])

    return docs.where("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_LOG2)).alias("at")).mapInArrow(run, f"id {id_type}, set binary")


def band_rows(rows: DataFrame) -> DataFrame:
    """rows: id, registers. One row (bucket, id) for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                r = np.stack([np.frombuffer(x, np.uint16) for x in part.column(1).to_pylist()]).reshape(-1, BANDS, ROWS).astype(np.uint64)
                h = np.zeros(r.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    h = mix(h * _STEP[0] + r[:, :, j])
                yield pa.record_batch([pa.array(h.ravel().astype(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], ["bucket", "id"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "registers").mapInArrow(run, f"bucket long, id {id_type}")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each two sets, by products of membership matrices of bounded width."""
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    twice = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[twice]]
    row, width = row[twice], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(sets), min(4096, width - at)), np.float32)
        has[row[lo:hi], column[lo:hi] - at] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """rows: bucket, i, j, side, id, component, set; sorted by block within partitions. Pairs (a, b) of components that are linked in a block.

    Each component of a block that has a link to another gets one pair with the smallest that it reaches there.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def flush(key: tuple, ids: list, comps: list, sides: list, sets: list, out: list) -> None:
        if len(set(comps)) < 2:
            return
        if len(ids) <= 4:
            common = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for x in sets] for y in sets])
        else:
            common = _intersections(sets)
        n, comp, side = np.array([len(s) for s in sets]), np.unique(comps, return_inverse=True)[1], np.array(sides)
        near = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        near &= comp[:, None] != comp[None, :]
        if key[1] != key[2]:
            near &= side[:, None] != side[None, :]
        if not near.any():
            return
        names, at = np.unique(comps, return_inverse=True)
        label = np.arange(len(names))
        while True:
            reach = np.where(near, label[at][None, :], len(names)).min(1)
            low = label.copy()
            np.minimum.at(low, at, reach)
            if (low == label).all():
                break
            label = low
        out += [(comps_of[label[k]], comps_of[k]) for comps_of in [names.tolist()] for k in range(len(names)) if label[k] != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, ([], [], [], []), []
        for batch in batches:
            for bucket, i, j, side, own, component, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, i, j) != key:
                    if key:
                        flush(key, *group, out)
                    key, group = (bucket, i, j), ([], [], [], [])
                for values, value in zip(group, (own, component, side, np.frombuffer(one, np.uint64)), strict=True):
                    values.append(value)
                if len(out) > 10_000:
                    yield made(out)
                    out = []
        if key:
            flush(key, *group, out)
        yield made(out)

    def made(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k in (0, 1)], ["a", "b"])

    kind = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Linked: 100 * intersection >= percent * union of the shingle sets."""
    id_type = docs.schema[id_col].dataType.simpleString()
    made = settle(sketches(docs, k, id_col, text_col))
    classes = settle(made.where("n_shingles > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep")))
    reps = made.join(classes.select(F.col("rep").alias("id"), "k1", "k2"), ["id", "k1", "k2"], "left_semi").select("id", F.col("n_shingles").alias("n"), "registers")
    reps = settle(reps)
    # Registers are read no more than here: the rows that the result reads go without them.
    made = settle(made.drop("registers"), made)
    members = settle(centered(band_rows(reps)))
    known = settle(reps.join(members.select("id").distinct(), "id", "left_semi"), reps)
    sets = settle(full_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, known))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b, n_a, n_b, r_a, r_b = (part.column(i) for i in range(6))
                r_a, r_b = (np.stack([np.frombuffer(x, np.uint16) for x in r.to_pylist()]) for r in (r_a, r_b))
                n_a, n_b = np.asarray(n_a).astype(float), np.asarray(n_b).astype(float)
                j = likely_jaccard((r_a == r_b).sum(1), n_a, n_b, (r_a > r_b).sum(1), (r_a < r_b).sum(1))
                t = percent / 100
                keep = (j >= t - MARGIN * np.sqrt(t * (1 - t) / REGISTERS)) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
                yield pa.record_batch([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (known.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")) for c in "ab")
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
        near = settle(rows.mapInArrow(likely, f"a {id_type}, b {id_type}"))
        left, right = (sets.select(F.col("id").alias(c), F.col("set").alias(f"s_{c}")) for c in "ab")
        return near.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(confirm, f"a {id_type}, b {id_type}")

    def across(rest: DataFrame) -> DataFrame:
        width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = in_blocks(rest).join(sets, "id").select("bucket", "i", "j", "side", "id", "component", "set")
        return block_links(rows.repartition(width, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), percent)

    found = link(members, known, verify, across, BLOCK, BLOCK_SHINGLES)
    discard(known)
    discard(sets)
    labels = settle(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("root")), classes, found)
    # Empty sets are left as they are; a component's smallest representative is its smallest id.
    out = made.select("id", "n_shingles", "k1", "k2").join(labels, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
