"""License scans: an Aho-Corasick automaton finds phrases and identifier tags; tagged expressions are parsed and evaluated.

Texts are lower-cased (A-Z) and cut to words; phrases match where their words stand consecutively. After a tag
`SPDX-License-Identifier:` a shunting-yard parser reads the expression (and, or, with, brackets) of the same line. It ends at
the first character that no expression holds (such as a comment's end). What doesn't parse to there (two identifiers in a
row, an operator without its sides, an open bracket, a plain word that names no licence) gives no label and no expression.

Null or empty texts have no words, no places and empty labels. Long texts and long expressions are read whole, in linear
time, without recursion. Equal texts get equal rows; labels are sorted. An empty table gives an empty one. Columns other than
id and text are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lekhani.llm.common import small_batches, table

#: Fixed by the contract: phrases and the label of each.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, in the words to which texts are cut.
NOTICES = {
    "the mit license": "mit", "mit licensed": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license 2 0": "apache-2", "apache 2 0 license": "apache-2", "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "mozilla public license version 2": "mpl-2", "mozilla public license 2 0": "mpl-2", "eclipse public license": "epl", "isc license": "isc",
    "creative commons attribution 4 0": "cc-by", "cc by 4 0": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0", "public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
#: SPDX identifiers, lower case, to labels; others keep their own identifier.
IDENTIFIERS = {"apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "cc-by-nc-4.0": "cc-by-nc", "cc-by-4.0": "cc-by", "cc0-1.0": "cc0", "mpl-2.0": "mpl-2"}
TAG = "spdx license identifier"
PRIORITY = {"or": 1, "and": 2, "with": 3}

_DELIMITERS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: Of each byte: a delimiter is a space, A-Z are lower case and so are parts of words.
CLEAN = bytes(32 if b in set(_DELIMITERS) and not 65 <= b <= 90 else b + 32 * (65 <= b <= 90) for b in range(256))
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: Licences whose identifiers are plain words; other identifiers hold a digit, a hyphen or a plus sign.
PLAIN = set("afmparse artistic beerware bsl caldera clartistic curl dotseqn gpl hpnd icu isc lgpl libpng mit mitnfa mpl naumen ncsa ntp ofl openssl php plexus postgresql psfrag python qhull ruby saxpath sendmail sleepycat snia ssh-short tcl unlicense vim w3c wtfpl xnet xpp zed zlib".split())
#: Licences that ask for no more than notices.
PERMISSIVE = frozenset("mit apache-2 bsd bsd-2-clause bsd-3-clause isc zlib unlicense 0bsd cc0 cc-by".split())


def parse_expression(text: str) -> list | str | None:
    """The tree of the expression that the text begins with: an identifier, or [operator, left, right]; None if it doesn't parse."""
    out: list = []
    stack: list[str] = []
    at, operand, opened = 0, True, 0
    while m := _TOKEN.match(text, at):
        token = m[1].lower()
        if operand:
            if token == "(":
                stack.append(token)
                opened += 1
            elif token == ")" or token in PRIORITY:
                return None
            else:
                token = token.rstrip(".:")
                if not (stack and stack[-1] == "with" or token in PLAIN or re.search("[0-9+-]", token)):
                    return None
                out.append(token)
                operand = False
        elif token in PRIORITY:
            while stack and stack[-1] != "(" and PRIORITY[stack[-1]] >= PRIORITY[token]:
                _reduce(out, stack.pop())
            stack.append(token)
            operand = True
        elif token == ")":
            if not opened:  # of the text around the tag
                break
            while (top := stack.pop()) != "(":
                _reduce(out, top)
            opened -= 1
        else:
            return None
        at = m.end()
    if operand or opened:
        return None
    while stack:
        _reduce(out, stack.pop())
    return out[0]


def _reduce(out: list, op: str) -> None:
    right, left = out.pop(), out.pop()
    out.append([op, left, right])


def licences(tree: list | str | None) -> set[str]:
    """The licences that a tree names; an exception after `with` is none."""
    found, todo = set(), [] if tree is None else [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            found.add(IDENTIFIERS.get(node, node))
        else:
            todo += node[1:2] if node[0] == "with" else node[1:]
    return found


def _folded(tree: list | str, leaf: Callable, join: Callable) -> object:
    """The tree's value: leaf(identifier), and join(operator, left, right) from the leaves up, by a stack."""
    todo, done = [(tree, False)], []
    while todo:
        node, ready = todo.pop()
        if isinstance(node, str):
            done.append(leaf(node))
        elif ready:
            right, left = done.pop(), done.pop()
            done.append(join(node[0], left, right))
        else:
            todo += [(node, True), (node[2], False), (node[1], False)]
    return done[0]


def permits(tree: list | str | None, allowed: set[str] | frozenset[str]) -> bool:
    """Can the work be used if only the allowed licences are taken? `or` needs one side, `and` both."""
    if tree is None:
        return False
    return _folded(tree, lambda x: IDENTIFIERS.get(x, x) in allowed, lambda op, left, right: left if op == "with" else left or right if op == "or" else left and right)


def written(tree: list | str) -> str:
    """The expression with its operators after their sides."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        else:
            out.append(node[0])
            todo += node[1:]  # the right side is taken first: the list is read backwards
    return " ".join(reversed(out))


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        self.base = base
        self.automaton = ahocorasick.Automaton()
        for phrase in {**notices, **base}:
            self.automaton.add_word(f" {phrase} ", (phrase, base.get(phrase), notices.get(phrase)))
        self.automaton.add_word(f" {TAG} ", (TAG, None, None))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, places of base phrases as (first word, last word, how many), base labels, all labels, expressions, score."""
        words = (text or "").encode().translate(CLEAN).split()
        joined = " " + b" ".join(words).decode("latin-1") + " "
        first = last = None
        n, base, labels, tagged, found = 0, set(), set(), False, 0
        counted = blanks = 0  # blanks before the place that was counted last
        for end, (phrase, own, more) in self.automaton.iter(joined):
            found += 1
            if own:
                blanks, counted = blanks + joined.count(" ", counted, end), end
                at = blanks - phrase.count(" ") - 1
                first, last, n = (at if first is None else min(first, at)), max(at, last or 0), n + 1
                base.add(own)
            labels |= {x for x in (own, more) if x}
            tagged |= phrase == TAG
        trees = []
        if tagged:
            trees = [t for m in _TAGGED.finditer(text) if (t := parse_expression(m[1])) is not None]
            for t in trees:
                labels |= licences(t)
        # Each place halves what is left of doubt; a parsed expression leaves a tenth of it.
        score = (1 - 0.5**found * 0.1 ** len(trees)) if labels else 0.0
        return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), trees, score


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, allowed: frozenset[str] = PERMISSIVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, permitted, expressions.

    permitted: do the allowed licences satisfy every tagged expression (null without one). expressions: as `written`.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permitted", "expressions"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in small_batches(batches, 1):
            rows = [(w, n, a, b, bl, al, s, all(permits(t, allowed) for t in trees) if trees else None, [written(t) for t in trees]) for w, n, a, b, bl, al, trees, s in map(scanner.scan, batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean, expressions array<string>")
    return out.withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("expressions")
