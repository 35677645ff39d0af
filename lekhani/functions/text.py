"""Text analysis as Catalyst expressions: normalising, tokens, stop words, stems, phonetic keys, Soundex, similarity.

Every function takes and returns Columns. Only Unicode composition and the romaniser need Python (see romanize.py).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Word lists, suffixes and tables that results depend on.
HINDI_STOP = """
का की के है हैं में और से को पर यह ये वह वे था थी थे एक लिए किया गया गई गए
कि जो भी तो ही इस उस इन उन कर ने हो होता होती होते होना नहीं या अपने अपना अपनी
उनके उसके उसकी उनकी उसका उनका तक साथ बाद द्वारा जैसे कुछ कई किसी सभी अब जब तब
रहा रही रहे करने करते करता करती हुआ हुई हुए होने वाले वाली वाला दिया दी
कौन क्या कब कहाँ कहां कैसे कैसा कैसी किस क्यों कितना कितने कितनी किसने किसको किसका किसकी किसके कौनसा कौनसी कोनसा कोनसी
""".split()
HINGLISH_STOP = """
ka ki ke hai hain h mein men me main aur or se ko par pe yah yeh ye vah woh wo ve tha thi the
ek liye kiya gaya gayi gaye ki jo bhi to toh hi is us in un kar ne ho hota hoti hote
nahi nahin ya apne apna apni tak sath saath baad dwara jaise kuch kai kisi sabhi ab jab tab
kaun kon kya kab kahan kaha kaise kaisa kaisi kis kyon kyu kyun kitna kitne kitni kisne kisko kiska kiski kiske
konsa konsi kaunsa kaunsi
hua hui hue raha rahi rahe karna karne karte karta karti hona hone wala wali wale vala vali vale
diya di liya gai gae
""".split()
ENGLISH_STOP = """
a an the of in on at to for from by with and or is are was were be been being
what who whom which when where why how does do did has have had it its this that these those
as about into than then there their they he she his her i you we
""".split()
SUFFIXES = """
ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां
ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां
ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं
कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें
ो े ू ु ी ि ा
""".split()
#: Phonetic class of each consonant; then which are aspirated and which retroflex.
KEY_CLASSES = {"K": "कख", "G": "गघ", "C": "चछ", "J": "जझ", "T": "टठतथ", "D": "डढदध", "N": "ङञणनं", "P": "पफ", "B": "बभ", "M": "म", "Y": "य", "R": "रऋृ", "L": "लळ", "V": "व", "S": "शषस", "H": "ह"}
ASPIRATED, RETROFLEX = "खघछझठथढधफभ", "टठडढणळ"
VOWEL_CLASSES = {"a": "अआा", "i": "इईिी", "u": "उऊुू", "e": "एऐेैऍॅ", "o": "ओऔोौऑॉ"}
ROMAN_ASPIRATES = {"gh": "G", "jh": "J", "th": "T", "dh": "D", "ph": "P", "bh": "B"}
ROMAN_LETTERS = {"k": "K", "q": "K", "c": "K", "g": "G", "j": "J", "z": "Z", "t": "T", "d": "D", "n": "N", "p": "P", "f": "F", "b": "B", "m": "M", "y": "Y", "r": "R", "l": "L", "v": "V", "w": "W", "s": "S", "h": "H"}
SOUNDEX_DIGITS = {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6", "aeiouhwy": "0"}
TOKEN = "[ऀ-ॣ०-ॿ]+|[a-z0-9]+"
DEVANAGARI = "[ऀ-ॿ]"
# End of fixed values.


def plain_normalize(text: str) -> str:
    """`normalize` for a few words on the driver."""
    text = unicodedata.normalize("NFC", text).replace("़", "").replace("ँ", "ं")
    return text.lower()


STOP_WORDS = sorted({plain_normalize(w) for w in HINDI_STOP + HINGLISH_STOP + ENGLISH_STOP})
STEM_SUFFIXES = sorted({s.replace("ँ", "ं") for s in SUFFIXES}, key=lambda s: (-len(s), s))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no function for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def compose(text: Column) -> Column:
    """Unicode composition. Texts of ASCII, which it leaves as they are, don't travel to Python and back."""
    return F.coalesce(nfc(F.when(~is_ascii(text), text)), text)


def normalize_devanagari(text: Column, composed: bool = False) -> Column:
    """composed: the text is known to be composed, so no Python is needed. Only texts with Devanagari or a joiner have what it changes."""
    c = text if composed else compose(text)
    d = F.translate(c, "ँ़‌‍", "ं")
    d = F.regexp_replace(d, "[ङञणनम]्(?=[क-ह])", "ं")
    d = F.translate(d, "०१२३४५६७८९।॥", "0123456789  ")
    return F.when(is_ascii(c) | ~c.rlike("[ऀ-ॿ‌‍]"), c).otherwise(d)


def normalize_roman(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"([a-z])\1{2,}", "$1")


def normalize(text: Column, composed: bool = False) -> Column:
    return normalize_roman(normalize_devanagari(text, composed))


def tokenize(text: Column, composed: bool = False) -> Column:
    """Tokens in order; null text has none."""
    return F.regexp_extract_all(normalize(F.coalesce(text, F.lit("")), composed), F.lit(TOKEN), F.lit(0))


def white_words(text: Column) -> Column:
    """Words between white space, as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_script(token: Column) -> Column:
    return F.when(token.rlike(DEVANAGARI), "deva").when(token.rlike("[a-z]"), "roman").otherwise("digit")


def query_script(tokens: Column) -> Column:
    deva = F.exists(tokens, lambda t: token_script(t) == "deva")
    roman = F.exists(tokens, lambda t: token_script(t) == "roman")
    return F.when(deva & roman, "mixed").when(deva, "deva").when(roman, "roman").otherwise("none")


def is_stop(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def stem(token: Column) -> Column:
    """Strips the longest suffix that leaves two characters; Roman tokens stay."""
    return F.when(token.rlike(DEVANAGARI), F.regexp_replace(token, f"^(.{{2,}}?)(?:{'|'.join(STEM_SUFFIXES)})$", "$1")).otherwise(token)


@dataclass(frozen=True)
class KeyRules:
    """Switches of the phonetic key; all on by default."""

    merge_aspiration: bool = True
    merge_retroflex: bool = True
    drop_vowels: bool = True
    merge_wv: bool = True
    merge_zj: bool = True
    merge_fp: bool = True
    nasal_rule: bool = True
    collapse_doubles: bool = True

    def without(self, rule: str) -> KeyRules:
        return replace(self, **{rule: False})


KEY_RULES = [f.name for f in fields(KeyRules)]


def _swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


#: Marks that make a unit of two characters one while the key is built: a small letter of the class in a private plane.
def _marked(letter: str, aspirated: bool, retroflex: bool) -> str:
    return chr(0xE000 + (ord(letter) - 65) + 32 * aspirated + 64 * retroflex)


def _devanagari_units(token: Column, rules: KeyRules) -> Column:
    old, new = "", ""
    for letter, members in KEY_CLASSES.items():
        for m in members:
            a, r = m in ASPIRATED and not rules.merge_aspiration, m in RETROFLEX and not rules.merge_retroflex
            old, new = old + m, new + (_marked(letter, a, r) if a or r else letter)
    for letter, members in VOWEL_CLASSES.items():
        old, new = old + members, new + letter * len(members)
    c = F.translate(_swap(token, [("ज्ञ", "GY")]), old, new)
    return F.regexp_replace(c, "[^A-Zaeiou0-9-]", "")


def _roman_units(token: Column, rules: KeyRules) -> Column:
    def cls(letter: str, aspirated: bool) -> str:
        return _marked(letter, True, False) if aspirated and not rules.merge_aspiration else letter

    c = _swap(token, [("chh", cls("C", True)), ("ck", "K"), ("kh", cls("K", True)), ("ch", "C"), ("sh", "S"), *((k, cls(v, True)) for k, v in ROMAN_ASPIRATES.items())])
    if rules.nasal_rule:
        c = F.regexp_replace(c, "m(?=[b-df-hj-np-tv-zA-Z-])", "N")
    merged = {"W": "V" if rules.merge_wv else "W", "Z": "J" if rules.merge_zj else "Z", "F": "P" if rules.merge_fp else "F"}
    letters = {k: merged.get(v, v) for k, v in ROMAN_LETTERS.items()}
    return F.translate(_swap(c, [("x", "KS")]), "".join(letters), "".join(letters.values()))


def _spell(units: Column) -> Column:
    """Marked units as letters with h and r."""
    for r in (False, True):
        for a in (False, True):
            if a or r:
                for letter in "KGCJTDNPBL":
                    units = F.replace(units, F.lit(_marked(letter, a, r)), F.lit(letter + "r" * r + "h" * a))
    return units


def phonetic_key(token: Column, rules: KeyRules = KeyRules()) -> Column:
    """The script-independent key; "" for digits and for keys of fewer than two units."""
    units = F.when(token.rlike(DEVANAGARI), _devanagari_units(token, rules)).otherwise(_roman_units(token, rules))
    if rules.drop_vowels:
        units = F.translate(F.regexp_replace(units, "^[aeiou]", "A"), "aeiou", "")
    if rules.collapse_doubles:
        units = F.regexp_replace(units, r"([^aeiou])\1+", "$1")
    units = F.translate(units, "aeiou", "AEIOU")
    units = F.regexp_replace(units, r"^.?\z", "")  # asked of its length in a condition, all of it would be made twice
    spelled = units if rules.merge_aspiration and rules.merge_retroflex else _spell(units)
    return F.when(token.rlike("^[0-9]+$"), "").otherwise(spelled)


def soundex_roman(word: Column) -> Column:
    """Own variant: vowels and h, w, y count as 0 and part equal digits; four characters; "" without a letter."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    digits = F.translate(letters, "".join(SOUNDEX_DIGITS), "".join(v * len(k) for k, v in SOUNDEX_DIGITS.items()))
    rest = F.replace(F.substring(F.regexp_replace(digits, r"(.)\1+", "$1"), 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.upper(F.substring(letters, 1, 1)), rest), 4, "0"))


def soundex(token: Column, roman: Column | None = None) -> Column:
    """roman: the token's romanisation, for Devanagari tokens."""
    source = token if roman is None else F.when(token.rlike(DEVANAGARI), roman).otherwise(token)
    return F.when(token.rlike("^[0-9]+$"), "").otherwise(soundex_roman(source))


def starts_with_sign(token: Column) -> Column:
    return token.rlike("^[ऀ-ःऺ-ॏ]")


def bigrams(text: Column) -> Column:
    """The set of character pairs of the text with a blank on each side; of an empty one too."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2))))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def relative_edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def snippet(text: Column, size: int = 220) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def highlight(text: Column, stems: Column, keys: Column) -> Column:
    """Words (cut at single blanks) with whether one of their tokens has a stem or a key of the query."""

    def marked(word: Column) -> Column:
        tokens = tokenize(word, composed=True)
        hit = F.exists(tokens, lambda t: F.array_contains(stems, stem(t)) | ((phonetic_key(t) != "") & F.array_contains(keys, phonetic_key(t))))
        return F.struct(word.alias("word"), hit.alias("hit"))

    return F.transform(F.split(text, " "), marked)
