"""Pieces of DuckDB SQL from which the reference rows of the queries are made, independently of the Spark plans."""

from __future__ import annotations

from lekhani.functions import text as T

MARK = chr(0xF000)
PRIVATE = [0xE000 + i for i in range(256)]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return ", ".join(map(lit, values))


def norm(e: str) -> str:
    e = f"translate(nfc_normalize(coalesce({e}, '')), {lit(chr(0x901) + chr(0x93C) + chr(0x200C) + chr(0x200D))}, {lit(chr(0x902))})"
    e = f"regexp_replace({e}, '(्)([क-ह])', {lit(chr(92) + '1' + MARK + chr(92) + '2')}, 'g')"
    e = f"replace(regexp_replace({e}, {lit('[ङञणनम]्' + MARK)}, 'ं', 'g'), {lit(MARK)}, '')"
    e = f"lower(translate({e}, '०१२३४५६७८९।॥', '0123456789  '))"
    for c in "abcdefghijklmnopqrstuvwxyz":
        e = f"regexp_replace({e}, '{c}{{3,}}', '{c}', 'g')"
    return e


def tok(e: str) -> str:
    return f"regexp_extract_all({norm(e)}, {lit(T.TOKEN)})"


STOP = words(T.STOP_WORDS)


def stop(e: str) -> str:
    return f"({e} IN ({STOP}))"


def content(e: str) -> str:
    return f"[x for x in {tok(e)} if x NOT IN ({STOP})]"


def deva(e: str) -> str:
    return f"regexp_matches({e}, {lit(T.DEVANAGARI)})"


def stem(e: str) -> str:
    return f"CASE WHEN {deva(e)} THEN regexp_replace({e}, {lit('^(.{2,}?)(?:' + '|'.join(T.STEM_SUFFIXES) + ')$')}, '\\1') ELSE {e} END"


def _mark(letter: str, h: bool, r: bool) -> str:
    return chr(0xE000 + ord(letter) - 65 + 32 * h + 64 * r) if h or r else letter


def units(e: str, rules: T.KeyRules = T.KeyRules()) -> str:
    """The key of a token as units of one character each, before they are spelled and before short ones are dropped."""
    old = new = ""
    for letter, members in T.KEY_CLASSES.items():
        for m in members:
            old, new = old + m, new + _mark(letter, m in T.ASPIRATED and not rules.merge_aspiration, m in T.RETROFLEX and not rules.merge_retroflex)
    for letter, members in T.VOWEL_CLASSES.items():
        old, new = old + members, new + letter * len(members)
    d = f"regexp_replace(translate(replace({e}, 'ज्ञ', 'GY'), {lit(old)}, {lit(new)}), {lit('[^A-Zaeiou0-9' + chr(0xE000) + '-' + chr(0xE0FF) + ']')}, '', 'g')"
    r = e
    asp = not rules.merge_aspiration
    for a, b in [("chh", _mark("C", asp, False)), ("ck", "K"), ("kh", _mark("K", asp, False)), ("ch", "C"), ("sh", "S"), ("gh", _mark("G", asp, False)), ("jh", _mark("J", asp, False)), ("th", _mark("T", asp, False)), ("dh", _mark("D", asp, False)), ("ph", _mark("P", asp, False)), ("bh", _mark("B", asp, False))]:
        r = f"replace({r}, '{a}', {lit(b)})"
    if rules.nasal_rule:
        for _ in range(2):
            r = f"regexp_replace({r}, {lit('m([b-df-hj-np-tv-zA-Z' + chr(0xE000) + '-' + chr(0xE0FF) + '])')}, 'N\\1', 'g')"
    letters = dict(T.ROMAN_LETTERS)
    for own, other, on in (("W", "V", rules.merge_wv), ("Z", "J", rules.merge_zj), ("F", "P", rules.merge_fp)):
        letters = {k: other if v == own and on else v for k, v in letters.items()}
    r = f"translate(replace({r}, 'x', 'KS'), {lit(''.join(letters))}, {lit(''.join(letters.values()))})"
    u = f"CASE WHEN {deva(e)} THEN {d} ELSE {r} END"
    if rules.drop_vowels:
        u = f"translate(regexp_replace({u}, '^[aeiou]', 'A'), 'aeiou', '')"
    if rules.collapse_doubles:
        marks = [_mark(c, h, x) for c in "KGCJTDNPBL" for h, x in ((True, False), (False, True), (True, True))] if asp or not rules.merge_retroflex else []
        for c in [*"ABCDFGHJKLMNPRSTVWYZ0123456789", *marks]:
            u = f"regexp_replace({u}, '{c}+', '{c}', 'g')"
    return u if rules.drop_vowels else f"translate({u}, 'aeiou', 'AEIOU')"


def spell(e: str, rules: T.KeyRules) -> str:
    if rules.merge_aspiration and rules.merge_retroflex:
        return e
    for x in (False, True):
        for h in (False, True):
            if h or x:
                for c in "KGCJTDNPBL":
                    e = f"replace({e}, {lit(_mark(c, h, x))}, '{c}{'r' * x}{'h' * h}')"
    return e


def key_from(u: str, token: str, rules: T.KeyRules = T.KeyRules()) -> str:
    return f"CASE WHEN regexp_full_match({token}, '[0-9]+') OR length({u}) < 2 THEN '' ELSE {spell(u, rules)} END"


def soundex_parts(e: str) -> tuple[str, str]:
    letters = f"regexp_replace(lower({e}), '[^a-z]', '', 'g')"
    digits = f"translate({letters}, {lit(''.join(T.SOUNDEX_DIGITS))}, {lit(''.join(v * len(k) for k, v in T.SOUNDEX_DIGITS.items()))})"
    for d in "0123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return letters, digits


def soundex(e: str) -> str:
    letters, digits = soundex_parts(e)
    return f"CASE WHEN regexp_full_match({e}, '[0-9]+') OR {letters} = '' THEN '' ELSE rpad(substr(upper(substr({letters}, 1, 1)) || replace(substr({digits}, 2), '0', ''), 1, 4), 4, '0') END"


def script(e: str) -> str:
    return f"CASE WHEN {deva(e)} THEN 'deva' WHEN regexp_matches({e}, '[a-z]') THEN 'roman' ELSE 'digit' END"


DOCS = "docs AS (SELECT doc_id, CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, 1, instr(t, chr(10)) - 1) ELSE '' END AS title, CASE WHEN instr(t, chr(10)) > 0 THEN substr(t, instr(t, chr(10)) + 1) ELSE t END AS body FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
TOKENS = f"""cut AS (SELECT doc_id, {tok('title')} AS tt, {tok('body')} AS bt FROM docs),
tok AS (SELECT doc_id, unnest(tt) AS token, unnest(range(len(tt))) AS pos, true AS in_title FROM cut UNION ALL SELECT doc_id, unnest(bt), unnest(range(len(tt) + 1, len(tt) + 1 + len(bt))), false FROM cut)"""
TOPICS = f"q AS (SELECT item_id AS qid, array_to_string(list_slice({content('text')}, 1, 6), ' ') AS text FROM benchmark)"
QTOK = f"qtok AS (SELECT qid, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT qid, {tok('text')} AS ts FROM q))"


def dictionary(sources: list[str]) -> str:
    every = " UNION ".join(f"SELECT DISTINCT token FROM {s}" for s in sources)
    return f"""dict0 AS (SELECT token, {stop('token')} AS stop, {stem('token')} AS stem, {units('token')} AS u, {soundex('token')} AS sdx FROM ({every})),
dict AS (SELECT token, stop, stem, sdx, {key_from('u', 'token')} AS key FROM dict0)"""


ZONE_SELECT = {
    "all": "SELECT 'all' AS zone, stem AS term, doc_id, pos FROM own",
    "title": "SELECT 'title' AS zone, stem AS term, doc_id, pos FROM own WHERE in_title",
    "dhvani": "SELECT 'dhvani' AS zone, key AS term, doc_id, pos FROM own WHERE key <> ''",
    "soundex": "SELECT 'soundex' AS zone, sdx AS term, doc_id, pos FROM own WHERE sdx <> ''",
    "nostem": "SELECT 'nostem' AS zone, token AS term, doc_id, pos FROM own",
    "raw": "SELECT 'raw' AS zone, unnest(ws) AS term, doc_id, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, [x for x in regexp_split_to_array(title || ' ' || body, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+') if x <> ''] AS ws FROM docs)",
}


def base(zones: list[str], queries: bool = False, topics: str = TOPICS) -> str:
    """WITH and the tables terms, post, tstat, dstat, zstat of the zones; with queries q and qtok and qown too."""
    parts = [DOCS, TOKENS]
    if queries:
        parts += [topics, QTOK]
    parts.append(dictionary(["tok", "qtok"] if queries else ["tok"]))
    parts.append("own AS (SELECT tok.doc_id, tok.token, tok.pos, tok.in_title, stem, key, sdx FROM tok JOIN dict USING (token) WHERE NOT stop)")
    if queries:
        parts.append("qown AS (SELECT qid, pos, qtok.token, stem, key, sdx FROM qtok JOIN dict USING (token) WHERE NOT stop)")
    parts.append("terms AS (" + " UNION ALL ".join(ZONE_SELECT[z] for z in zones) + ")")
    parts.append("post AS (SELECT zone, term, doc_id, count(*) AS tf FROM terms GROUP BY ALL)")
    parts.append("tstat AS (SELECT zone, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY ALL)")
    zs = ", ".join(f"('{z}')" for z in zones)
    parts.append(f"dstat AS (SELECT z.zone, d.doc_id, coalesce(n.doc_len, 0)::BIGINT AS doc_len, coalesce(n.norm, 1.0) AS lnc_norm FROM docs d CROSS JOIN (VALUES {zs}) z(zone) LEFT JOIN (SELECT zone, doc_id, sum(tf) AS doc_len, sqrt(sum(power(1 + log10(tf), 2))) AS norm FROM post GROUP BY ALL) n ON n.zone = z.zone AND n.doc_id = d.doc_id)")
    parts.append("zstat AS (SELECT zone, count(*) AS n, avg(doc_len) AS avg_len FROM dstat GROUP BY zone)")
    return "WITH " + ",\n".join(parts)


QKIND = {"all": "stem", "title": "stem", "dhvani": "key", "soundex": "sdx", "nostem": "token"}


def qterms(zones: list[str]) -> str:
    parts = []
    for z in zones:
        if z == "raw":
            parts.append("SELECT qid, 'raw' AS zone, term, count(*) AS qtf FROM (SELECT qid, unnest(string_split(text, ' ')) AS term FROM q) WHERE term <> '' GROUP BY ALL")
        else:
            parts.append(f"SELECT qid, '{z}' AS zone, {QKIND[z]} AS term, count(*) AS qtf FROM qown WHERE {QKIND[z]} <> '' GROUP BY ALL")
    return "qt AS (" + " UNION ALL ".join(parts) + ")"


def bm25(weights: dict[str, float], k1: float = 0.9, b: float = 0.5, pooled: bool = False, source: str = "post") -> str:
    """Tables qt, pool, zs (zone scores) and s (sums)."""
    w = "CASE qt.zone " + " ".join(f"WHEN '{z}' THEN {v}::DOUBLE" for z, v in weights.items()) + " END"
    pool = "pool AS (SELECT k.qid, k.term, greatest(coalesce(a.df, 0), coalesce(d.df, 0)) AS df FROM (SELECT qid, stem AS term, arg_max(key, pos) AS key FROM qown GROUP BY ALL) k LEFT JOIN tstat a ON a.zone = 'all' AND a.term = k.term LEFT JOIN tstat d ON d.zone = 'dhvani' AND d.term = k.key)" if pooled else "pool AS (SELECT NULL::BIGINT AS qid, NULL::VARCHAR AS term, NULL::BIGINT AS df)"
    df = "CASE WHEN qt.zone IN ('all', 'title') AND pool.df > 0 THEN pool.df ELSE t.df END" if pooled else "t.df"
    return f"""{qterms(list(weights))}, {pool},
zs AS (SELECT qt.qid, p.doc_id, qt.zone, sum({w} * qt.qtf * ln(1 + (z.n - ({df}) + 0.5) / (({df}) + 0.5)) * p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * d.doc_len / z.avg_len))) AS score
  FROM qt JOIN tstat t ON t.zone = qt.zone AND t.term = qt.term JOIN zstat z ON z.zone = qt.zone JOIN {source} p ON p.zone = qt.zone AND p.term = qt.term JOIN dstat d ON d.zone = p.zone AND d.doc_id = p.doc_id LEFT JOIN pool ON pool.qid = qt.qid AND pool.term = qt.term GROUP BY ALL),
s AS (SELECT qid, doc_id, sum(score) AS score FROM zs GROUP BY ALL)"""


def top(source: str = "s", k: int = 10, digits: int = 6, name: str = "run") -> str:
    return f"{name} AS (SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(score, {digits}) AS score FROM {source}) WHERE score > 0) WHERE rank <= {k})"
