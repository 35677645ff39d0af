"""Each operator against brute force or a library, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import random
import re

import numpy as np
import pytest

from lekhani.llm import bpe, decontaminate, embeddings, html, language, licenses, lines, linking, lm, minhash, quality

random.seed(3)
WORDS = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(2, 9))) for _ in range(400)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(t, n):
    w = t.split(" ")
    for i in random.sample(range(len(w)), n):
        w[i] = random.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = [text(120) for _ in range(8)]
    rows = [*base, *(edited(b, k) for b in base for k in (1, 2, 4, 9)), *base[:3], "", "  ", None, "one", "two words", text(30_000)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], "doc_id long, text string, id string, norm string, n int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def roots(n, pairs):
    up = {i: i for i in n}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 7), (100, 9)]
    got = {r["id"]: r["component"] for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots({x for p in pairs for x in p}, pairs)


def test_minhash(docs, texts, nothing):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and sets[b]]
    want = roots(sets, pairs)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert minhash.near_duplicates(nothing).count() == 0


def test_intersections():
    sets = [np.unique(np.random.default_rng(k).integers(0, 900, 300).astype(np.uint64)) for k in range(7)]
    got = minhash._intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(7) for j in range(7) if i != j)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64)) for _ in range(2))
    b = np.concatenate([a[:600], b[:300]])
    ra, rb = minhash.registers(a), minhash.registers(b)
    assert (minhash.merge(ra, rb) == minhash.registers(np.union1d(a, b))).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = minhash.likely_jaccard(*(np.array([x]) for x in ((ra == rb).sum(), float(len(a)), float(len(b)), (ra > rb).sum(), (ra < rb).sum())))[0]
    assert abs(got - j) < 0.15


def test_lines(spark, nothing):
    base = [text(40) for _ in range(6)]
    rows = [(0, "\n".join(base)), (1, base[0].upper() + "\n\n" + edited(base[1], 1)), (2, base[2] + "  \n" + text(40) + "\n" + base[2]), (3, None), (4, ""), (5, "a"), (6, "A"), (7, "你好世界" * 30 + "\n" + "b"), (8, "你好世界" * 30 + "了")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, no int")
    every = [(i, k, re.sub(r"\s+", " ", line.lower()).strip()) for i, t in rows if t for k, line in enumerate(t.split("\n"))]
    every = [x for x in every if x[2]]

    def shingles(s):
        return {s[i : i + 8] for i in range(len(s) - 7)} if len(s) >= 8 else {s}

    n = range(len(every))
    pairs = [(a, b) for a in n for b in n if a < b and len(x := shingles(every[a][2]) & shingles(every[b][2])) >= 0.8 * len(shingles(every[a][2]) | shingles(every[b][2]))]
    want = {every[i][:2]: every[r][:2] for i, r in roots(n, pairs).items()}
    got = {(r["doc_id"], r["line_no"]): (r["keeper_id"], r["keeper_no"]) for r in lines.line_groups(docs).collect()}
    assert got == want
    out = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs).collect()}
    assert out[0] == rows[0][1] and out[1] == "" and out[3] is None and out[4] == "" and out[6] == "" and out[7] == rows[7][1] and out[8] == ""
    assert lines.drop_repeated_lines(docs).columns == docs.columns and lines.line_groups(nothing).count() == 0


def test_lines_run_no_python(docs):
    plan = lines.signed(lines.distinct_lines(lines.numbered_lines(docs, "doc_id", "text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64))
    v = [b + s * rng.standard_normal(64) * np.linalg.norm(b) / 8 for b in base for s in (0, 0.3, 1.5, 3, 20)]
    v += [v[0], 3 * v[0]]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    odd = [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] * 64), (504, [1.0, None]), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    unit = np.array([x / np.linalg.norm(x) for _, x in ((i, np.array(x)) for i, x in rows)])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(len(v)), zip(*np.nonzero(np.triu(near)), strict=True))
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == want[i] for i in range(len(v)))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (500, 501, 502, 503, 504, 505, 506)] == [(0, 500), (0, 501), (0, 502), (0, 503), (0, 504), (1, 505), (1, 505)]


def test_decontamination(spark, nothing):
    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return min(row)

    for _ in range(20):
        p, t = text(6), edited(text(30), 3)
        got = decontaminate.myers(p, t, len(p))
        assert got[0] == distance(p, t)
    items = [(i, text(30)) for i in range(5)] + [(9, None), (10, "")]
    inside = lambda t: text(40) + " " + t + " " + text(40)
    rows = [(0, inside(items[0][1])), (1, inside(items[1][1].upper().replace(" ", ", "))), (2, inside(items[2][1][:60] + "zz" + items[2][1][62:])), (3, text(90)), (4, None), (5, ""), (6, inside(edited(items[3][1], 15)))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for i, t in rows:
        for k, p in items:
            a, b = decontaminate.normal(t), decontaminate.normal(p)
            if a and b and (d := distance(b, a)) <= int(len(b) * decontaminate.RATE):
                want[i, k] = d
    assert got == want and set(want) == {(0, 0), (1, 1), (2, 2)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0 and decontaminate.find_leaks(nothing, bench).count() == 0


def test_language(spark, nothing):
    two = {"aa": "bada gadi lomu kari ", "bb": "thring shwump skreld ", "cc": "ñéo çàü êîô "}
    rows = [(i, " ".join(random.choice(two[k].split()) for _ in range(20)), k) for i, k in enumerate(list(two) * 40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(0, two["aa"]), (1, two["bb"].upper()), (2, two["cc"]), (3, None), (4, ""), (5, "12 !"), (6, two["bb"] * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["aa", "bb", "cc", "und", "und", "und", "bb"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.train(spark.createDataFrame([], "text string, lang string")) is None and language.identify(nothing, model).count() == 0
    assert len({tuple(c) for c in language.codewords(9)}) == 9


def test_quality(spark, docs):
    rows = [(i, text(50).capitalize() + ".") for i in range(60)] + [(100 + i, " ".join(w + "!!" for w in text(50).upper().split())) for i in range(20)]
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.rate(d, labels).collect()}
    assert all(got[i]["predicted"] == int(i < 100) for i, _ in rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert quality.rate(docs, labels.limit(0)).count() == docs.count()


def test_lm(spark, nothing):
    good, bad = [text(60) for _ in range(20)], [" ".join("".join(random.choice("qrstuvwxyz") for _ in range(5)) for _ in range(60)) for _ in range(20)]
    rows = list(enumerate(good + bad)) + [(90, None), (91, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.exact_scores(d, d.where("doc_id < 10")).collect()}
    assert min(got[i]["score"] for i in range(20)) > max(got[i]["score"] for i in range(20, 40)) and got[90]["n_tokens"] == 0 and got[91]["score"] == 0
    assert lm.exact_scores(nothing, nothing).count() == 0 and lm.exact_scores(d, nothing).count() == len(rows)


def test_html():
    tree = html.grow()
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href=a>Home</a></nav><div class='cookie-notice'>We use cookies to make this long sentence longer.</div><article><h1>Big &lt;x&gt;</h1><p>First <b>bold</b>\n text.<p>Of.<p>Of.<div class=ad>Buy</div></article><div id=comments><p>Great article, I read all of it with joy and will again.</p></div><footer>end</footer></body></html>"
    assert html.main_text(page, tree) == "Big <x>\nFirst bold text.\nOf.\nOf."
    assert html.main_text(None, tree) == html.main_text("", tree) == "" and html.main_text("<p>" * 3000 + "x", tree) == "x"


def test_bpe(spark):
    import tokenizers

    path = bpe.tokenizer_path()
    theirs, mine = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    theirs.no_truncation()
    theirs.no_padding()
    every = [text(200), "", "<|endoftext|>a b<|startoftext|>", "ΑΣ ΣΣ İstanbul it's WE'VE", "aaaa" * 500, "😀 你好 नमस्ते\x1c\x85x", "".join(random.choice("the ing!?.'09éß") for _ in range(3000))]
    every += ["a" + chr(c) + "b" + chr(c) for c in range(1, 0x3000)]
    for t in every:
        ids = theirs.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert list(np.frombuffer(got, "<u4")) == ids and mine.decode(got).decode() == theirs.decode(ids, skip_special_tokens=False)
    rows = spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_digests(rows, path).collect()}[1] == 0 and bpe.encode_texts(rows, path).count() == 2


def test_licenses(spark, docs):
    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for t in [None, "", "Released UNDER the-MIT license. cc by-nc 4.0 under the MIT license", "Apache License, Version 2.0 é cc by nc by nc", text(500)]:
        w = words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, v) for p, v in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        n, base, first, last, labels, every, _, score = scanner.scan(t)
        assert (n, base, first, last, labels) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at})))
        assert set(filter(None, labels.split(","))) <= set(every.split(",")) and 0 <= score <= 1
    tree = licenses.parse_expression("(MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0 -->")
    assert tree == ["and", ["or", "mit", "apache-2.0"], ["with", "gpl-3.0-only", "classpath-exception-2.0"]]
    assert licenses.licences(tree) == {"mit", "apache-2", "gpl-3"} and licenses.permits(tree, {"mit", "gpl-3"}) and not licenses.permits(tree, {"mit"})
    assert scanner.scan("// SPDX-License-Identifier: MIT OR Apache-2.0\n")[5] == "apache-2,mit" and licenses.parse_expression("OR x") is None
    assert licenses.scan_licenses(docs).count() == docs.count()
