"""Tagged expressions of any length, texts that only look like one, labels and score against plain reading, and rows through Spark."""

import time

from lekhani.llm import licenses

SCANNER = licenses.Scanner(licenses.BASE, licenses.NOTICES)


def labels(text):
    return SCANNER.scan(text)[5]


def test_what_does_not_parse_gives_no_label():
    tag = "SPDX-License-Identifier: "
    for rest in ("the quick brown fox", "MIT OR", "OR MIT", "MIT Apache-2.0", "((MIT", "", "()", "MIT WITH", "the"):
        assert licenses.parse_expression(rest) is None and labels(tag + rest) == "", rest
    assert labels(tag + "MIT */") == labels(tag + "(MIT)") == labels(f"({tag}MIT)") == "mit"
    assert labels(tag + "Apache-2.0 WITH LLVM-exception OR ISC\nMIT") == "apache-2,isc"


def test_long_expressions():
    every = [f"lic-{i}" for i in range(20_000)]
    for text in (" AND ".join(every), "(" * 5000 + " OR ".join(every) + ")" * 5000, "".join(f"({x} and " for x in every) + "mit" + ")" * len(every)):
        began = time.time()
        tree = licenses.parse_expression(text)
        assert set(every) <= licenses.licences(tree) and licenses.written(tree).startswith("lic-0 lic-1")
        assert licenses.permits(tree, set(every) | {"mit"}) and not licenses.permits(tree, set())
        assert time.time() - began < 2


def test_permits():
    tree = licenses.parse_expression("MIT AND (GPL-3.0 OR Apache-2.0 WITH x-exception)")
    assert licenses.written(tree) == "mit gpl-3.0 apache-2.0 x-exception with or and"
    assert licenses.permits(tree, {"mit", "apache-2"}) and licenses.permits(tree, {"mit", "gpl-3"}) and not licenses.permits(tree, {"gpl-3", "apache-2"})
    assert not licenses.permits(None, {"mit"})


def test_many_places():
    began = time.time()
    n = 40_000
    assert SCANNER.scan("released under the MIT license. " * n)[:5] == (5 * n, n, 1, 5 * (n - 1) + 1, "mit")
    assert time.time() - began < 1


def test_labels_and_score_by_plain_reading():
    texts = ["", "under the mit license", "cc by nc and CC-BY-SA", "public domain; all rights reserved", "SPDX-License-Identifier: Zlib", "a\nSPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC or the\n under the mit license cc by nc nd"]
    for t in texts:
        words = "".join(c.lower() if c.isalnum() else " " for c in t).split()
        places = [(p, x) for x in (licenses.BASE, licenses.NOTICES) for p in x for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        tags = t.lower().count(licenses.TAG.replace(" ", "-")[:-10])
        trees = [tree for line in t.split("\n") if "Identifier:" in line and (tree := licenses.parse_expression(line.split("Identifier:")[1]))]
        want = {x[p] for p, x in places} | set().union(*map(licenses.licences, trees))
        found = len({(p, i) for p in {p for p, _ in places} for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}) + tags
        assert labels(t) == ",".join(sorted(want)), t
        assert abs(SCANNER.scan(t)[7] - ((1 - 0.5**found * 0.1 ** len(trees)) if want else 0)) < 1e-12, t


def test_through_spark(spark):
    long = "SPDX-License-Identifier: " + " AND ".join(["MIT"] * 1200)
    rows = [(1, long, "x", 0.5), (1, long, "x", 0.5), (2, None, None, None), (None, "under the MIT license", "", 1.0), (3, "", "", 0.0), (4, "SPDX-License-Identifier: MIT OR GPL-3.0", "", 0.0), (5, "SPDX-License-Identifier: MIT AND GPL-3.0", "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, labels string, score double")
    out = licenses.scan_licenses(docs)
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0] or 0)
    assert out.dtypes[0] == ("doc_id", "int") and got[1] == got[2] and got[1][6] == "mit" and len(got[1][9]) == 1
    assert got[0][:7] == (None, 4, 1, 0, 0, "mit", "mit") and got[3][:9] == (2, 0, 0, None, None, "", "", 0.0, None) and got[4][1:3] == (0, 0)
    assert [got[k][8] for k in (1, 5, 6)] == [True, True, False]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
