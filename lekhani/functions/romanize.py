"""Romanising Devanagari, casual respelling and ITRANS: Python over Arrow batches, meant for distinct tokens."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The romaniser's tables.
CONSONANTS = {"क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h"}
WITH_NUKTA = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "फ": "f", "ड": "r", "ढ": "rh", "य": "y"}
INITIAL_VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri", "ऑ": "o", "ऍ": "e"}
SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ृ": "ri", "ॉ": "o", "ॅ": "e"}
SHORTER = [("aa", "a"), ("ee", "i"), ("oo", "u")]
CASUAL = [("a", "aa"), ("i", "ee"), ("u", "oo"), ("ee", "i"), ("oo", "u"), ("v", "w"), ("w", "v"), ("j", "z"), ("sh", "s"), ("ph", "f"), ("kh", "k"), ("gh", "g"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("ai", "e"), ("au", "o"), ("e", "ai")]
ITRANS_CONSONANTS = {"k": "क", "kh": "ख", "g": "ग", "gh": "घ", "ch": "च", "chh": "छ", "Ch": "छ", "j": "ज", "jh": "झ", "T": "ट", "Th": "ठ", "D": "ड", "Dh": "ढ", "N": "ण", "t": "त", "th": "थ", "d": "द", "dh": "ध", "n": "न", "p": "प", "ph": "फ", "b": "ब", "bh": "भ", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "sh": "श", "Sh": "ष", "s": "स", "h": "ह", "q": "क", "z": "ज", "f": "फ", "x": "क्ष"}
ITRANS_VOWELS = {"a": ("अ", ""), "aa": ("आ", "ा"), "A": ("आ", "ा"), "i": ("इ", "ि"), "ii": ("ई", "ी"), "ee": ("ई", "ी"), "I": ("ई", "ी"), "u": ("उ", "ु"), "uu": ("ऊ", "ू"), "oo": ("ऊ", "ू"), "U": ("ऊ", "ू"), "e": ("ए", "े"), "ai": ("ऐ", "ै"), "o": ("ओ", "ो"), "au": ("औ", "ौ")}
# End of fixed values.

_SYLLABLE = re.compile(rf"([{''.join(CONSONANTS)}])(़?)(्|[{''.join(SIGNS)}]?)|([{''.join(INITIAL_VOWELS)}])|([ँं])|(ः)|([०-९])")


def _syllables(word: str) -> list[dict]:
    """onset, vowel, silent (an unwritten a that may fall), nasal."""
    out: list[dict] = []
    for m in _SYLLABLE.finditer(unicodedata.normalize("NFD", word)):
        consonant, nukta, after, vowel, nasal, visarga, digit = m.groups()
        part = {"onset": "", "vowel": "", "silent": False, "nasal": bool(nasal)}
        if consonant:
            part["onset"] = WITH_NUKTA.get(consonant, CONSONANTS[consonant]) if nukta else CONSONANTS[consonant]
            part["silent"] = not after
            part["vowel"] = SIGNS.get(after, "" if after else "a")
        elif vowel:
            spelled = INITIAL_VOWELS[vowel]
            for long, short in SHORTER if out else []:
                spelled = spelled.replace(long, short)
            part["vowel"] = spelled
        elif visarga:
            part["onset"] = "h"
        elif digit:
            part["onset"] = str(ord(digit) - ord("०"))
        out.append(part)
    return out


def romanize_word(word: str) -> str:
    parts = _syllables(word)

    def sounds(p: dict) -> bool:
        return p["onset"] != "" and not p["nasal"]

    if parts and parts[-1]["silent"] and sum(map(sounds, parts)) >= 2:
        joined = len(parts) > 1 and sounds(parts[-2]) and not parts[-2]["vowel"]
        if not (joined and parts[-1]["onset"] in ("r", "y", "v")):
            parts[-1]["vowel"] = ""
    for before, here, after in zip(parts, parts[1:], parts[2:], strict=False):
        if here["silent"] and before["vowel"] and sounds(after) and after["vowel"] and not after["silent"]:
            here["vowel"] = ""
    out = []
    for p, after in zip(parts, [*parts[1:], {"onset": "", "nasal": False}], strict=True):
        labial = not after["nasal"] and after["onset"][:1] in ("p", "b", "m") and after["onset"] != ""
        out.append(("m" if labial else "n") if p["nasal"] else p["onset"] + p["vowel"])
    return "".join(out)


def romanize_text(text: str) -> str:
    return " ".join(romanize_word(w) if re.search("[ऀ-ॿ]", w) else w.lower() for w in text.split())


def _draw(n: int, *of: object) -> int:
    """A number under n that depends on the arguments only."""
    return int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=8).digest(), "big") % n


def casual_text(text: str, key: object, seed: int, p: float = 0.3) -> str:
    """Each word gets one random respelling at a random place with probability p, drawn from hashes of (key, seed, place)."""
    out = []
    for k, w in enumerate(romanize_text(text).split()):
        fits = [(a, b) for a, b in CASUAL if a in w]
        if fits and _draw(1_000_000, key, seed, k) < p * 1_000_000:
            a, b = fits[_draw(len(fits), key, seed, k, "rule")]
            at = [m.start() for m in re.finditer(f"(?={a})", w)]
            i = at[_draw(len(at), key, seed, k, "place")]
            w = w[:i] + b + w[i + len(a) :]
        out.append(w)
    return " ".join(out)


_ITRANS = re.compile("|".join(sorted([*ITRANS_CONSONANTS, *ITRANS_VOWELS], key=len, reverse=True)) + "|.", re.DOTALL)


def itrans_word(token: str) -> str:
    """Roman to Devanagari by ITRANS; a virama at the end is dropped. Approximates the usual scheme's common part."""
    out, open_consonant = [], False
    for m in _ITRANS.finditer(token):
        piece = m[0]
        if piece in ITRANS_CONSONANTS:
            out += ["्"] * open_consonant + [ITRANS_CONSONANTS[piece]]
            open_consonant = True
        elif piece in ITRANS_VOWELS:
            out.append(ITRANS_VOWELS[piece][open_consonant])
            open_consonant = False
        else:
            out += ["्"] * open_consonant + [piece]
            open_consonant = False
    return "".join(out)


def romanize(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else romanize_text(t))

    return run(text)


def itrans(token: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else itrans_word(t))

    return run(token)


def casual(text: Column, key: Column, seed: int, p: float = 0.3) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else casual_text(t, str(i), seed, p) for t, i in zip(s, k, strict=True)])

    return run(text, key.cast("string"))
