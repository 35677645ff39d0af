"""Cross-entropy difference: a target and a background word-bigram model over one vocabulary score each document.

Words (lower-cased A-Z, cut at white space) and pairs of neighbouring words are counted over whole texts, each under its own
64-bit hash. A word's probability is its pair's count, with PRIOR times its own share added, over the count of the word
before plus PRIOR; its own share is smoothed over the vocabulary (words of either side). The background counts are scaled to
the target's number of words, so both are smoothed alike. A token's difference is log p_target - log p_background; a
document's score is the mean over its words. Documents take part in the counts that score them, on both sides alike.

Counts are exact: nothing is capped or shared but by equal 64-bit hashes. A pair's word decides its part; a part's pairs are
summed, and with them the words' own counts and their counts as the word before, so a part scores its pairs alone. Tasks sum
slices of texts first and send packed columns, which name a text by its place in its slice. Words and pairs with a share of 1
/ HOT of all tokens, of which there can be HOT at most, are known to all tasks: hot words' pairs are dealt by the pair, and
hot pairs are scored where they stand, so no part grows with one word's or one pair's share of the corpus.

Null or empty texts have no words and score 0. A word at a text's start follows a start sign. Equal texts get equal scores
(sums are over all copies of a text, known by 63 bits of its hash). Long texts are read whole, in slices of SLICE bytes or
one text. Without target documents the models differ by nothing that a text shows: the score is then that of smoothing. An
empty table gives an empty one. Columns other than id and text are left out, whatever their names. docs must be read in the
same order each time a task is run again, as a table is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.llm.common import BATCH_BYTES, LOWER, NOT_BLANK, discard, mix, setting, settle, small_batches, span_hashes, table, text_bytes, word_spans

#: Weight of a word's own share beside its pairs' counts, and what smoothing adds to each word of the vocabulary.
PRIOR, ADDED = 2.0, 0.05
#: Passes over the texts, each over its share of the parts: bounds the rows on disk at a time.
PASSES = 2
#: Hot words and hot pairs: at most so many of each.
HOT = 1 << 16
#: Bytes of text that are summed together, and tokens of a part: a part's counts take 60 bytes for each pair at most, 32 MB.
SLICE, PART_TOKENS = 1 << 22, 1 << 19
#: Bytes that go to a Python worker at once, but for a longer row.
BATCH = 1 << 23
_START = np.uint64(0x243F6A8885A308D3)
_32 = np.uint64(32)
#: Kinds of packed rows: a part's counts, entries of texts that ask for them, sums that are ready.
COUNTS, ENTRIES, SUMS = 0, 1, 2
#: A slice's id, where its sums meet, and the bytes of each step from text to text and of each number of entries.
_HEAD = "<qiBB"


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word, of the word before it, of the pair; and for each text the index of its first word (n + 1 values)."""
    raw, off = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, off, NOT_BLANK)
    h = span_hashes(raw, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = _START
    return h, before, mix(before * np.uint64(0x9E3779B97F4A7C15) + h), first


def _last(first: np.ndarray) -> np.ndarray:
    """True for the last word of each text."""
    out = np.zeros(first[-1], bool)
    out[first[1:][first[1:] > first[:-1]] - 1] = True
    return out


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """searchsorted of many values, which are looked up in their order: neighbours find the same memory."""
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(known, wanted[order])
    return at


class Lookup:
    """Places of hashes among sorted known ones, by their first bits: values with the same ones stand side by side."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known, self.shift = known, np.uint64(64 - self.BITS)
        self.start = np.searchsorted(known >> self.shift, np.arange((1 << self.BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max())
        self.padded = np.append(known, np.zeros(self.longest + 1, np.uint64))

    def __reduce__(self) -> tuple:
        return Lookup, (self.known,)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of wanted values, and whether they are known."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        found = (self.padded[at] == wanted) & (at < len(self.known))
        for k in range(1, self.longest):
            here = (self.padded[at + k] == wanted) & (at + k < len(self.known)) & ~found
            at = np.where(here, at + k, at)
            found |= here
        return at, found


def _by_part(part: np.ndarray) -> np.ndarray:
    """A stable order by part; of few parts by counting."""
    part = part - part.min() if len(part) else part
    return np.argsort(part.astype(np.int16 if len(part) and part.max() < 1 << 15 else np.int32), kind="stable")


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


class Totals:
    """What all tasks know: totals of both sides, and the counts (own, and as the word before) of hot words. Column 0 is the target's."""

    def __init__(self, rows: list, vocabulary: int, tokens: tuple[int, int], parts: int):
        rows = sorted((np.uint64(r["word"] & (1 << 64) - 1), r) for r in rows)
        self.words = np.array([w for w, _ in rows], np.uint64)
        self.lookup = Lookup(self.words)
        self.own = np.array([(r["t"], r["b"]) for _, r in rows], np.int64).reshape(-1, 2)
        self.before = self.own - np.array([(r["tl"], r["bl"]) for _, r in rows], np.int64).reshape(-1, 2)
        self.parts = parts
        self.scale = np.array([1.0, tokens[0] / tokens[1] if tokens[0] and tokens[1] else 1.0])
        self.spread = np.array(tokens) * self.scale + ADDED * max(vocabulary, 1)

    def part(self, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The part of each pair: by its word, or by itself where the word is hot."""
        key = mix(np.where(self.lookup.find(word)[1], pair, word) ^ np.uint64(0x5851F42D4C957F2D))
        return ((key >> _32) * np.uint64(self.parts) >> _32).astype(np.int64)

    def log_before(self, counts: np.ndarray) -> np.ndarray:
        return np.log(counts * self.scale + PRIOR)

    def log_share(self, pairs: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.log(pairs * self.scale + PRIOR * (own * self.scale + ADDED) / self.spread)


_PACKED = "part int, kind int, a binary, b binary, c binary, d binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, *data = zip(*rows, strict=True) if rows else [()] * 6
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in data)], ["part", "kind", "a", "b", "c", "d"])


def _planes(x: np.ndarray, size: int = 8) -> np.ndarray:
    """Column by column the first bytes of all values, then their second ones and so on: like bytes side by side are compressed."""
    return np.ascontiguousarray(x.T).view(np.uint8).reshape(-1, 8).T[:size]


def _thin(x: np.ndarray) -> np.ndarray:
    """Planes of whole numbers, as many as the largest takes."""
    return _planes(x.astype(np.int64), max(1, -(-int(x.max()).bit_length() // 8)))


def _unfold(data: bytes, n: int, columns: int, dtype: type = np.int64) -> np.ndarray:
    """The n rows of values that planes hold."""
    planes = np.frombuffer(data, np.uint8).reshape(-1, n * columns)
    out = np.zeros((n * columns, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return np.ascontiguousarray(out.view(dtype).reshape(columns, n).T)


def _cut(part: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows of columns that are sorted by part."""
    at = _runs(part)
    for lo in range(0, len(at), 256):
        ends = np.append(at[lo + 1 : lo + 257], len(part))[: len(at) - lo][:256]
        yield _packed([(int(part[a]), kind, *(c[a:b] for c in columns)) for a, b in zip(at[lo : lo + 256], ends, strict=True)])


def _dealt(rows: DataFrame) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(width, F.col("part")).sortWithinPartitions("part", "kind")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """All rows of each part, from rows that are sorted by part."""
    now, group = None, []
    for part, _, data in _grouped(batches):
        if part != now and group:
            yield now, group
            group = []
        now = part
        group.append(data)
    if group:
        yield now, group


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [batch.column(c)[i].as_py() for c in range(2, 6)]


def _word_counts(texts: DataFrame) -> DataFrame:
    """texts: side, text. One packed row for each part: words (sorted), and of each the counts t, b of its places and tl, bl of those that end a text.

    The start sign ends minus one text for each text, as it is the word before without being a word.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, SLICE):
            h, _, _, first = hashes(batch.column(1))
            sides = np.asarray(batch.column(0))
            side = np.repeat(sides, np.diff(first))
            words, at = np.unique(h, return_inverse=True)
            last = _last(first)
            four = [np.bincount(at[keep & (side == s)], minlength=len(words)) for keep in (np.ones(len(h), bool), last) for s in (0, 1)]
            begun = [-int(((sides == s) & (first[1:] > first[:-1])).sum()) for s in (0, 1)]
            words = np.append(words, _START)
            counts = np.stack([np.append(x, v) for x, v in zip(four, (0, 0, *begun), strict=True)], 1).astype(np.int32)
            part = ((mix(words) >> _32) * np.uint64(width) >> _32).astype(np.int64)
            own = _by_part(part)
            yield from _cut(part[own], COUNTS, words[own], counts[own], counts[:0], counts[:0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _parts(batches):
            words, counts = np.concatenate([np.frombuffer(g[0], np.uint64) for g in group]), np.concatenate([np.frombuffer(g[1], np.int32).reshape(-1, 4) for g in group])
            order = np.argsort(words)
            at = _runs(words[order])
            yield _packed([(part, COUNTS, words[order][at], np.add.reduceat(counts[order].astype(np.int64), at), at[:0], at[:0])])

    return _dealt(texts.select("side", "text").mapInArrow(send, _PACKED)).mapInArrow(add, _PACKED)


def _word_totals(counted: DataFrame) -> tuple[int, tuple[int, int]]:
    """The number of words of either side, and each side's number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _grouped(batches):
            counts = np.frombuffer(data[1], np.int64).reshape(-1, 4)[:, :2]
            yield pa.record_batch([pa.array([int((counts.sum(1) > 0).sum())]), *(pa.array([int(x)]) for x in counts.sum(0))], ["words", "t", "b"])

    size, t, b = counted.mapInArrow(run, "words long, t long, b long").agg(F.sum("words"), F.sum("t"), F.sum("b")).first()  # three numbers
    return size or 0, (t or 0, b or 0)


def _hot_words(counted: DataFrame, least: float) -> list:
    """word, t, b, tl, bl of the words that occur so often in both sides together, and of the start sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _grouped(batches):
            words, counts = np.frombuffer(data[0], np.uint64), np.frombuffer(data[1], np.int64).reshape(-1, 4)
            hot = (counts[:, :2].sum(1) >= least) | (words == _START)
            yield pa.record_batch([pa.array(words[hot].astype(np.int64)), *(pa.array(counts[hot, i]) for i in range(4))], ["word", "t", "b", "tl", "bl"])

    return counted.mapInArrow(run, "word long, t long, b long, tl long, bl long").collect()  # HOT + 1 rows at most


def _pair_counts(texts: DataFrame, totals: Totals, mine: range) -> DataFrame:
    """texts: side, text. One packed row for each part of one pass: pairs (sorted); as planes their counts, their words' places, the words' counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, SLICE):
            h, _, pair, first = hashes(batch.column(1))
            side = np.repeat(np.asarray(batch.column(0)), np.diff(first))
            order = np.argsort(pair)
            at = _runs(pair[order])
            if not len(at):
                continue
            last, counts = _last(first), np.zeros((len(at), 4), np.uint32)
            if side.min() == side.max():  # the texts of a slice are of one side, but where a task's two tables meet
                counts[:, side[0]] = np.diff(np.append(at, len(order)))
                counts[:, 2 + side[0]] = np.add.reduceat(last[order], at, dtype=np.uint32)
            else:
                for i, x in enumerate((side == 0, side == 1, (side == 0) & last, (side == 1) & last)):
                    counts[:, i] = np.add.reduceat(x[order], at, dtype=np.uint32)
            pair, word = pair[order][at], h[order][at]
            part = totals.part(word, pair)
            own = np.flatnonzero((part >= mine.start) & (part < mine.stop))
            own = own[np.argsort(word[own])]  # equal words side by side are compressed
            own = own[_by_part(part[own])]
            yield from _cut(part[own], COUNTS, pair[own], word[own], counts[own], counts[:0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in _parts(batches):
            yield summed(part, group)

    def summed(part: int, group: list) -> pa.RecordBatch:
        pair, word = (np.concatenate([np.frombuffer(g[i], np.uint64) for g in group]) for i in (0, 1))
        counts = np.concatenate([np.frombuffer(g[2], np.uint32).reshape(-1, 4) for g in group])
        order = np.argsort(pair)
        at = _runs(pair[order])
        counts = np.add.reduceat(counts[order], at, dtype=np.int64)
        words, place = np.unique(word[order][at], return_inverse=True)
        own = np.stack([np.bincount(place, counts[:, i], len(words)) for i in range(4)], 1).astype(np.int64)
        own[:, 2:] = own[:, :2] - own[:, 2:]  # a word is the word before wherever it ends no text
        known, hot = totals.lookup.find(words)
        own[hot, :2], own[hot, 2:] = totals.own[known[hot]], totals.before[known[hot]]
        return _packed([(part, COUNTS, pair[order][at], _thin(counts[:, :2]), _thin(place), _thin(own))])

    return _dealt(texts.mapInArrow(send, _PACKED)).mapInArrow(add, _PACKED)


def _hot_pairs(counted: DataFrame, least: float) -> list:
    """pair, t, b of the pairs that occur so often in both sides together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (pair, counts, _, _) in _grouped(batches):
            pair = np.frombuffer(pair, np.uint64)
            counts = _unfold(counts, len(pair), 2)
            hot = counts.sum(1) >= least
            yield pa.record_batch([pa.array(pair[hot].astype(np.int64)), pa.array(counts[hot, 0]), pa.array(counts[hot, 1])], ["pair", "t", "b"])

    return counted.mapInArrow(run, "pair long, t long, b long").collect()  # HOT rows at most


def _sums(docs: DataFrame, counted: DataFrame, totals: Totals, hot: list, mine: range) -> DataFrame:
    """docs: key, text, and row, a number that no other row has. key, n, t, b: parts of the sums of losses of each text, over the pairs of one pass."""
    hot = sorted((np.uint64(r["pair"] & (1 << 64) - 1), r["t"], r["b"]) for r in hot)
    hot_pairs, hot_counts = Lookup(np.array([r[0] for r in hot], np.uint64)), np.array([r[1:] for r in hot], np.int64).reshape(-1, 2)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = totals.log_before(totals.before[np.flatnonzero(totals.words == _START)[0]])
        for batch in small_batches(batches, 1, SLICE):
            h, _, pair, first = hashes(batch.column(1))
            if not len(h):
                continue
            last, key = _last(first), np.asarray(batch.column(0)).astype(np.uint64)
            doc = np.repeat(np.arange(len(key)), np.diff(first))
            at, here = hot_pairs.find(pair)
            part = np.full(len(h), -1)
            part[~here] = totals.part(h[~here], pair[~here])
            place, _ = totals.lookup.find(h[here])  # a hot pair's word is hot
            loss = totals.log_before(totals.before[place]) * ~last[here, None] - totals.log_share(hot_counts[at[here]], totals.own[place])
            whole = np.stack([np.bincount(doc[here], loss[:, i], len(key)) for i in (0, 1)], 1)
            n = np.diff(first)
            if mine.start:  # lengths and starts count in the first pass
                n = n * 0
            whole = whole + (n > 0)[:, None] * begin
            start = np.asarray(batch.column(2))[:1].astype(np.int64)  # no other slice has it
            mark = int(mix(start.view(np.uint64))[0] >> np.uint64(33))  # where the slice's sums meet
            yield _packed([(mark, SUMS, key, _thin(n), _planes(whole), np.frombuffer(struct.pack(_HEAD, start[0], mark, 0, 0), np.uint8))])
            own = np.flatnonzero((part >= mine.start) & (part < mine.stop))
            if not len(own):
                continue
            own = own[_by_part(part[own])]  # texts stay together within a part
            part, doc, last, pair = part[own], doc[own], last[own], pair[own]
            cuts, ends = _runs(part * len(key) + doc), _runs(part)
            # Each row of a part: the entries' pairs, steps from text to text of the slice, the entries of each text, the slice and whether entries end their text.
            runs, text, begins = np.diff(np.append(cuts, len(own))), doc[cuts], np.searchsorted(cuts, ends)
            steps = np.diff(text, prepend=0)
            steps[begins] = text[begins]
            steps, runs = (x.astype(np.min_scalar_type(int(x.max()))) for x in (steps, runs))
            head = np.frombuffer(struct.pack(_HEAD, start[0], mark, steps.itemsize, runs.itemsize), np.uint8)
            ends, begins = np.append(ends, len(own)), np.append(begins, len(cuts))
            for lo in range(0, len(ends) - 1, 256):
                spans = [(ends[i], ends[i + 1], slice(begins[i], begins[i + 1])) for i in range(lo, min(lo + 256, len(ends) - 1))]
                yield _packed([(int(part[a]), ENTRIES, pair[a:b], steps[of], runs[of], np.append(head, np.packbits(last[a:b]))) for a, b, of in spans])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, held = None, [], 0
        for part, kind, data in _grouped(batches):
            if kind == SUMS:
                ready.append((part, SUMS, *(np.frombuffer(x, np.uint8) for x in data)))
            elif kind == COUNTS:
                now, known = part, np.frombuffer(data[0], np.uint64)
                counts, place = _unfold(data[1], len(known), 2), _unfold(data[2], len(known), 1)[:, 0]
                own = _unfold(data[3], int(place.max()) + 1, 4)
                share, follow = -totals.log_share(counts, own[place, :2]), totals.log_before(own[:, 2:])
                continue
            else:
                assert part == now  # each pair was counted
                at = _places(known, np.frombuffer(data[0], np.uint64))
                _, mark, _, size = struct.unpack_from(_HEAD, data[3])
                last = np.unpackbits(np.frombuffer(data[3], np.uint8, offset=struct.calcsize(_HEAD)), count=len(at)).astype(bool)
                loss = share[at] + follow[place[at]] * ~last[:, None]
                runs = np.frombuffer(data[2], f"u{size}").astype(np.int64)
                loss = np.add.reduceat(loss, np.cumsum(runs) - runs)
                ready.append((mark, SUMS, np.frombuffer(data[1], np.uint8), runs[:0], _planes(loss), np.frombuffer(data[3][: struct.calcsize(_HEAD)], np.uint8)))
            held += sum(x.nbytes for x in ready[-1][2:])
            if held > 1 << 20:
                yield _packed(ready)
                ready, held = [], 0
        if ready:
            yield _packed(ready)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _parts(batches):
            slices: dict[bytes, list] = {}
            for data in group:
                slices.setdefault(data[3][:8], []).append(data)
            for own in slices.values():
                yield summed(own)

    def summed(group: list) -> pa.RecordBatch:
        """The sums of a slice: of its rows one has the texts' keys and lengths, the others the sums of a part."""
        (key, n, whole, _), = (g for g in group if g[1])
        key = np.frombuffer(key, np.uint64)
        n, total = _unfold(n, len(key), 1)[:, 0], _unfold(whole, len(key), 2, np.float64)
        for steps, _, loss, head in (g for g in group if not g[1]):
            at = np.cumsum(np.frombuffer(steps, f"u{struct.unpack(_HEAD, head)[2]}"), dtype=np.int64)
            total[at] += _unfold(loss, len(at), 2, np.float64)  # a text stands once in a row
        some = total.any(1) | (n > 0)
        return rows(key[some], n[some], total[some])

    def rows(key: np.ndarray, n: np.ndarray, loss: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key.astype(np.int64)), pa.array(n), pa.array(loss[:, 0]), pa.array(loss[:, 1])], ["key", "n", "t", "b"])

    parts = _dealt(counted.union(docs.mapInArrow(ask, _PACKED))).mapInArrow(answer, _PACKED)
    return _dealt(parts).mapInArrow(add, "key long, n long, t double, b double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "t", "b")))


def _key(text_col: str):
    """63 bits of the text's hash; texts that aren't there share that of the empty one."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text_col, F.lit(""))), 1)


def exact_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, target_loss and background_loss (nats a word), score (their difference; more is nearer the target).

    docs are the background and what is scored.
    """
    with setting(docs.sparkSession, BATCH_BYTES, str(BATCH)):
        return _exact_scores(docs, target, id_col, text_col)


def _exact_scores(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    target = settle(target.select(F.lit(0).alias("side"), F.col(text_col).alias("text")))  # read in each pass
    texts = target.union(docs.select(F.lit(1).alias("side"), F.col(text_col).alias("text")))
    words = settle(_word_counts(texts))
    size, tokens = _word_totals(words)
    least = max(1.0, sum(tokens) / HOT)
    hot_words = _hot_words(words, least) if size else []
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(width, -(-sum(tokens) // (PASSES * PART_TOKENS)))
    totals = Totals(hot_words, size, tokens, each * PASSES)
    passes = [range(i * each, (i + 1) * each) for i in range(PASSES)]
    discard(words)
    keyed = docs.select(_key(text_col).alias("key"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    sums = []
    if hot_words:
        for mine in passes:
            counted = settle(_pair_counts(texts, totals, mine), compression="snappy")  # hashes: little else compresses
            sums.append(settle(_sums(keyed, counted, totals, _hot_pairs(counted, least), mine), counted))
    discard(target)
    out = docs.select(F.col(id_col), _key(text_col).alias("key"))
    if not sums:
        return out.select(id_col, F.lit(0).cast("long").alias("n_tokens"), *(F.lit(0.0).alias(c) for c in ("target_loss", "background_loss", "score")))
    every = sums[0]
    for more in sums[1:]:
        every = every.union(more)
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    every = every.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "t", "b"))).join(copies, "key")
    every = settle(every.select("key", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("t") / F.col("n")).alias("target_loss"), (F.col("b") / F.col("n")).alias("background_loss")), *sums)
    out = out.join(every, "key", "left").na.fill(0, ["n_tokens", "target_loss", "background_loss"])
    return out.select(id_col, "n_tokens", "target_loss", "background_loss", (F.col("background_loss") - F.col("target_loss")).alias("score"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that are labelled as good and not toxic. Background: all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return exact_scores(docs, docs.join(good.hint("shuffle_hash"), "doc_id", "left_semi"))
