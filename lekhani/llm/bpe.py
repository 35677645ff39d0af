"""BPE encoding by backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token from each position. A token may follow another only
if merging their joined symbols leaves both as they are; that is looked up in a table of pairs. If no token fits, the
encoder steps back and tries the next shorter one, and marks positions from which no way leads on, so that time is
linear in the length. The result equals that of applying the merges by rank.

Null or empty texts have no tokens and decode to "". Long texts are handled whole. Repeated rows are encoded one by one. An
empty table gives an empty one. Columns other than id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer as Reference

from lekhani.llm.common import small_batches, table

#: Fixed values of the tokenizer file's kind: white space of Unicode and the pattern of its pre-tokenizer.
BLANK = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+"
BLANKS = re.compile(f"[{BLANK}]+")
#: str.split() takes these for white space and the pattern does not.
ODD_BLANK = re.compile("[\x1c-\x1f]")
#: Words whose tokens a worker remembers; at this number it starts anew.
CACHE = 1 << 18
#: Added to a symbol that ends a word.
END = 256


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def unassigned() -> str:
    """A class of the characters to which this Python's Unicode tables give no meaning, as ranges."""
    cat, out, first = unicodedata.category, [], None
    for c in range(0x110001):
        if c <= 0x10FFFF and cat(chr(c)) == "Cn":
            first = c if first is None else first
        elif first is not None:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(c - 1))}")
            first = None
    return "".join(out)


BYTE_OF = byte_characters()
FAR = re.compile("[^\x00-\u0377]")
NEWER = re.compile(f"[{unassigned()}]")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokenizer:
    """A BPE tokenizer with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        suffix = model["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            s = "".join(chr(BYTE_OF[c]) for c in (token[: -len(suffix)] if ends else token))
            return s[:-1] + chr(ord(s[-1]) + END) if ends else s

        vocab = model["vocab"]
        text_of = {i: symbols(t) for t, i in vocab.items()}
        self.id_of = {s: i for i, s in text_of.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.pair = {p: self.id_of[text_of[p[0]] + text_of[p[1]]] for p in self.rank}
        self.made = {}
        for p, k in self.rank.items():
            self.made.setdefault(self.pair[p], (*p, k))
        self.length = [len(text_of.get(i, "")) for i in range(max(text_of) + 1)]
        self.fits: dict[tuple[int, int], bool] = {}
        usable = {i for i, s in text_of.items() if self.merged(s) == [i]}
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(text_of[i], i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.length)
        for i in usable:
            s = text_of[i]
            self.shorter[i] = next((j for n in range(len(s) - 1, 0, -1) if (j := self.id_of.get(s[:n])) in usable), -1)
        self.whole = {text_of[i]: pack([i]) for i in usable}
        self.ending, self.starting = {}, {}
        self.words: dict[str, bytes] = {}
        self.pattern = regex.compile(WORDS)
        self.library = Reference.from_file(path)
        self.special = {t["content"]: t["id"] for t in added}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        contents = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        parts = [(contents.get(i, "") + " ").encode() for i in range(max(contents) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)

    def merged(self, symbols: str) -> list[int]:
        """Merges by rank, the plain way; only for single tokens."""
        parts = [self.id_of[c] for c in symbols]
        while len(parts) > 1:
            k, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if k == 1 << 60:
                break
            parts[at : at + 2] = [self.pair[parts[at], parts[at + 1]]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at the token's right (1) or left (0) edge while it is merged, each with the rank that ends it."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until = self.made[token][2]
            token = self.made[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Do a and b stay as they are if their symbols are merged in one word?"""
        known = self.fits.get((a, b))
        if known is None:
            left = self.ending.get(a) or self.ending.setdefault(a, self._edge(a, 1))
            right = self.starting.get(b) or self.starting.setdefault(b, self._edge(b, 0))
            rank = self.rank.get
            # Of equal ranks the leftmost pair merges first: within a before, within b after the pair across.
            known = not any((k := rank((x, y))) is not None and k < x_until and k <= y_until for x, x_until in left for y, y_until in right)
            if len(self.fits) >= CACHE:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def encode_word(self, word: str) -> bytes:
        s = word.encode().decode("latin-1")
        s = s[:-1] + chr(ord(s[-1]) + END)
        if (whole := self.whole.get(s)) is not None:
            return whole
        n, length, shorter, fits = len(s), self.length, self.shorter, self.fits
        longest = [0] * (n + 1)
        for end, token in self.automaton.iter(s):
            longest[end + 1 - length[token]] = token  # of those from one place the last is the longest
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + length[token]
            if end in dead:
                fit = False
            elif last < 0:
                fit = True
            elif (fit := fits.get((last, token))) is None:
                fit = self.compatible(last, token)
            if fit:
                out.append(token)
                at, last, token = end, token, longest[end]
            elif (token := shorter[token]) < 0:
                dead.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
        return pack(out)

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.encode_word(word)
            if len(word) < 64:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[word] = got
        return got

    def _plain(self, text: str, out: list[bytes]) -> None:
        if not text.isascii():
            if FAR.search(text) and NEWER.search(text):  # this Python's tables lack these characters
                text = self.library.normalizer.normalize_str(text)
                out += [self.encode_word(bytes(BYTE_OF[c] for c in w).decode()) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
                return
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each character by itself: no final sigma
        text = text.lower()
        known = self.words
        # No word holds white space, so what stands between two blanks is encoded by itself, mostly from memory.
        for w in BLANKS.split(text) if ODD_BLANK.search(text) else text.split():
            got = known.get(w)
            if got is None:
                got = b"".join(map(self._word, self.pattern.findall(w)))
                if len(w) < 64:
                    known[w] = got
            out.append(got)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        text = text or ""
        if self.special_pattern and "<|" in text:
            for m in self.special_pattern.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(pack([self.special[m[0]]]))
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings joined by one space, in UTF-8, cut from one buffer by the table of offsets."""
        if not ids:
            return b""
        out = []
        every = np.frombuffer(ids, "<u4").astype(np.int64)
        for k in range(0, len(every), 1 << 16):
            part = every[k : k + (1 << 16)]
            starts, sizes = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            begin = np.cumsum(sizes) - sizes
            out.append(self.buffer[np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int), decoded text. Null text counts as empty; other columns are left out."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in small_batches(batches, 1):
            ids = [t.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([t.decode(x).decode() for x in ids], pa.string())], ["id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for batch in small_batches(batches, 1):
            n, a, b = [], [], []
            for x in batch.column(1).to_pylist():
                ids = t.encode(x)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(t.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path())
