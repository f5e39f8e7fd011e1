import pytest
from pyspark.sql import functions as F
from support import assert_same, duck

from corpusmill.llm import licenses, line_dedup
from corpusmill.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op6_licenses", "op10_line_dedup"])
def test_equal_sql(spark, small, name):
    assert_same(queries()[name](spark, small), duck(small).sql(oracle_sql()[name]))


def test_templates_generalise_fields(table, prose):
    docs = [(i, f"{prose(i, 20)}\nPage {i} of the long report, printed by user {i * 7}\n{prose(100 + i, 20)}", "en", "s", 0) for i in range(6)]
    docs += [(10, "Page two", "en", "s", 0), (11, docs[0][1], "en", "s", 0)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(docs)).collect()}
    assert got[0].n_dropped == 0 and got[0].n_recurring == 1 and "Page 0" in got[0].text
    assert all(got[i].n_dropped == 1 and "Page" not in got[i].text and got[i].text.count("\n") == 1 for i in range(1, 6))
    assert (got[10].n_recurring, got[10].text) == (0, "Page two")


def test_copies_do_not_recur(table, prose):
    text = f"{prose(1, 30)}\n{prose(2, 30)}"
    got = line_dedup.line_dedup(table([(i, text, "en", "s", 0) for i in range(50)])).collect()
    assert {r.n_recurring for r in got} == {0}


def test_long_passage_recurs(table, prose):
    passage = prose(77, 60)
    docs = [(i, f"{prose(i, 25)}\n{passage}\n{prose(500 + i, 25)}", "en", "s", 0) for i in range(30)]
    got = line_dedup.line_dedup(table(docs)).collect()
    assert sum(passage in r.text for r in got) == 1 and {r.n_recurring for r in got} == {1}
    kept = line_dedup.deduped_documents(table(docs + [(99, passage, "en", "s", 0)]))
    assert kept.columns == table([]).columns and kept.count() == 30 and all(r.n_chars == len(r.text) for r in kept.filter("n_chars > 0").collect())


def test_equal_lines_recur_in_two_documents(table, prose):
    passage, stamp = prose(78, 60), "Posted 12 May 2021 at 10:45"
    docs = [(1, f"{prose(1, 25)}\n{passage}\n{stamp}", "en", "s", 0), (2, f"{passage}\n{prose(2, 25)}\n{stamp}", "en", "s", 0)]
    docs += [(3, f"{prose(3, 25)}\nPosted 13 May 2021 at 10:45", "en", "s", 0), (4, docs[0][1], "en", "s", 0), (5, f"{prose(5, 25)}\n{prose(6, 9)}\n{prose(6, 9)}", "en", "s", 0)]
    got = {r.doc_id: r.text for r in line_dedup.deduped_documents(table(docs)).collect()}
    assert got[1] == docs[0][1] and got[2] == prose(2, 25) and got[3] == docs[2][1] and got[4] == docs[0][1] and got[5] == docs[4][1]


def test_passages_inside_lines(table, prose):
    sentences = [prose(200 + k, 14).capitalize() + "." for k in range(4)]
    passage = " ".join(sentences)
    docs = [(1, f"{prose(1, 9)} {passage} {prose(2, 9)}\n{prose(3, 9)}", "en", "s", 0), (2, f"{prose(4, 20)} {passage}\n\n{prose(5, 9)}", "en", "s", 0)]
    docs += [(3, f"{sentences[0]} {sentences[1]}\n{sentences[2]} {sentences[3]}\nOwn words. Yes.", "en", "s", 0), (4, f"Yes. {prose(6, 9)}", "en", "s", 0)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(table(docs)).collect()}
    assert got[1].text == docs[0][1] and (got[1].n_dropped, got[1].n_cut) == (0, 0)
    # the first sentence has other words before it, so it differs
    assert got[2].text == f"{prose(4, 20)} {sentences[0]}\n\n{prose(5, 9)}" and (got[2].n_dropped, got[2].n_cut) == (0, 3)
    assert got[3].text == f"{sentences[0]}\nOwn words. Yes." and got[4].text == docs[3][1]
    assert {r.doc_id for r in line_dedup.deduped_documents(table(docs + [(9, passage, "en", "s", 0)])).collect()} == {1, 2, 3, 4}


def test_masked_tokens_and_long_runs(spark):
    import re
    import time

    texts = ["a1 b\tc22d\n9 x-5- y", "1", "", "no digit", "abc", " 1a \x0b2\f", "é7é 7", "a\n1\n\nb2c d"]
    runs = ["x" * 1_000_000 + " 1", "x" * 1_000_000 + "1", ("y" * 500_000 + "\t") * 2 + "2z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + runs)], "i int, t string")
    began = time.time()
    got = [r.m for r in df.select("i", line_dedup.masked(F.col("t")).alias("m")).orderBy("i").collect()]
    assert time.time() - began < 30
    assert got == [re.sub(r"[^ \t\x0b\f\r\n]+", lambda m: "<*>" if re.search("[0-9]", m[0]) else m[0], t) for t in texts + runs]


def test_odd_lines(odd_docs, no_docs):
    rows = line_dedup.line_dedup(odd_docs).collect()
    assert len(rows) == 10 and sorted(repr(r.text) for r in rows) == sorted(repr(r.text) for r in odd_docs.collect())
    assert line_dedup.line_dedup(no_docs).count() == 0 and line_dedup.deduped_documents(no_docs).count() == 0
    assert line_dedup.deduped_documents(odd_docs).count() == 10


def scan(df):
    return {r.doc_id: r for r in licenses.scan_licenses(df, F.col("path")).collect()}


SCHEMA = "doc_id long, text string, path string"


def test_headers_files_and_inheritance(table, prose):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"), (2, prose(1, 40), "a/b/c/x.txt"), (3, "Licensed under the Apache License, Version 2.0.", "a/b/LICENSE"),
        (4, prose(2, 40), "a/b/d/e/y.txt"), (5, f"{prose(3, 40)}\nThis work is licensed under the GNU General Public License, version 3.\n{prose(4, 9)}", "a/b/z.txt"),
        (6, prose(5, 40), "a/q.txt"), (7, prose(6, 40), "n/o.txt"), (8, None, "a/b/null.txt"), (9, prose(7, 30), None), (10, "", "top"),
    ]
    got = scan(table(rows, SCHEMA))
    assert {i: (r.licence, r.origin, r.directory) for i, r in got.items()} == {
        1: ("MIT", "file", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "file", None), 4: ("Apache-2.0", "inherited", "a/b"),
        5: ("GPL-3.0-only", "header", None), 6: ("MIT", "inherited", "a"), 7: (None, None, None), 8: ("Apache-2.0", "inherited", "a/b"), 9: (None, None, None), 10: (None, None, None),
    }


def test_licence_edges(table):
    assert scan(table([], SCHEMA)) == {}
    got = licenses.scan_licenses(table([(None, "All rights reserved.", None), (1, "All rights reserved.", "d/a"), (1, "All rights reserved.", "d/a")], SCHEMA), F.col("path")).collect()
    assert [r.licence for r in got] == ["LicenseRef-all-rights-reserved"] * 3


def test_blank_lines_and_dots_of_any_number(table):
    rows = [(n, "Released under the MIT License." + "\n" * n + "end", f"a/{n}") for n in (1, 2000, 1_000_000)]
    rows += [(5, "Released under the MIT License.\n" + "." * 300_000 + "x", "a/5"), (6, "Released under the MIT License.\n" + "- \t*\n" * 100_000 + "y", "a/6")]
    assert {r.licence for r in scan(table(rows, SCHEMA)).values()} == {"MIT"}


def test_notices_in_pages_are_not_passed_on(table, prose):
    rows = [(1, "Released under the MIT License.", "a/page.txt"), (2, prose(1, 40), "a/other.txt"), (3, "Licensed under the Apache License, Version 2.0.", "b/LICENSE"), (4, prose(2, 40), "b/x.txt")]
    got = scan(table(rows, SCHEMA))
    assert {i: (r.licence, r.origin) for i, r in got.items()} == {1: ("MIT", "notice"), 2: (None, None), 3: ("Apache-2.0", "file"), 4: ("Apache-2.0", "inherited")}


def test_anchors_lose_nothing():
    forms = licenses.templates()
    idf = {t: 1.0 + len(t) % 5 for _, _, terms in forms for t in terms}
    for limit in (0.3, 0.5, 0.8):
        needed = licenses.anchors(forms, idf, limit)
        for _, _, terms in forms:
            weights = licenses._weights(terms, idf)
            assert sum(w * w for t, w in weights.items() if t not in needed) < limit**2
            heavy = sorted((w * w for w in weights.values()), reverse=True)
            assert sum(heavy[: licenses.least_terms(terms, idf, limit) - 1]) < limit**2


# Openings of public licence files and the notices that they ask for.
MIT_FILE = f"MIT License\n\nCopyright (c) 2020 Some Body\n\n{licenses.MIT_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
ISC_FILE = "Copyright (c) 2020, Some Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
GNU = licenses.GNU_NOTICE


def commented(text, mark):
    import textwrap

    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, 60))


def test_real_licences(table, prose):
    import os

    bsd = f"Copyright (c) 2020 X. All rights reserved.\n\n{licenses.BSD_OPENING}\n\n{licenses.BSD_CLAUSES}"
    files = {
        "MIT": MIT_FILE, "ISC": ISC_FILE, "BSD-2-Clause": bsd, "BSD-3-Clause": f"{bsd}\n\n{licenses.BSD_NAMES}",
        "Apache-2.0": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "GPL-3.0-only": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies",
        "LGPL-2.1-only": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nEveryone is permitted to copy", "MPL-2.0": "Mozilla Public License Version 2.0\n====\n\n1. Definitions",
        "AGPL-3.0-only": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nPreamble",
    }
    system = {"GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    for name, licence in system.items():
        if os.path.exists(f"/usr/share/common-licenses/{name}"):
            files[f"{licence} {name}"] = open(f"/usr/share/common-licenses/{name}").read()
    headers = {
        "MIT": licenses.MIT_GRANT, "ISC": ISC_FILE.split("\n\n")[1], "BSD-3-Clause": f"{licenses.BSD_OPENING} {licenses.BSD_CLAUSES} {licenses.BSD_NAMES.replace('copyright holder', 'University')}",
        "GPL-3.0-or-later": GNU.format(what="program", mark=":", kind="", stop=",", version="3"), "GPL-2.0-or-later": GNU.format(what="program", mark=";", kind="", stop=";", version="2"),
        "LGPL-2.1-or-later": GNU.format(what="library", mark=";", kind="Lesser ", stop=";", version="2.1"), "AGPL-3.0-or-later": GNU.format(what="program", mark=":", kind="Affero ", stop=",", version="3"),
        "Apache-2.0": next(x for n, x in licenses.TEMPLATES if n == "Apache-2.0" and "obtain a copy" in x), "MPL-2.0": next(x for n, x in licenses.TEMPLATES if n == "MPL-2.0" and "obtain one" in x),
    }
    rows = [(i, prose(i, 60), f"own/p{i}.txt") for i in range(300)]
    names = ("LICENSE", "COPYING", "LICENCE.txt", "NOTICE.md")
    for k, text in enumerate(files.values()):
        rows += [(1000 + 2 * k, text, f"f{k}/{names[k % 4]}"), (1001 + 2 * k, prose(k, 50), f"f{k}/src/a.py")]
    for k, text in enumerate(headers.values()):
        rows += [(2000 + 2 * k, f"#!/bin/x\n{commented(text, '#*/'[k % 3])}\n\n{prose(k, 80)}", f"h{k}/x.c"), (2001 + 2 * k, prose(k, 50), f"h{k}/y.c")]
    got = scan(table(rows, SCHEMA))
    assert {f: got[1000 + 2 * k].licence for k, f in enumerate(files)} == {f: f.split()[0] for f in files}
    assert [got[1001 + 2 * k].licence for k in range(len(files))] == [f.split()[0] for f in files]
    assert {h: got[2000 + 2 * k].licence for k, h in enumerate(headers)} == {h: h for h in headers}
    # a header is no licence file, so its neighbours inherit nothing
    assert {got[2001 + 2 * k].licence for k in range(len(headers))} == {None} and {got[i].licence for i in range(300)} == {None}


def test_terms_agree(spark):
    texts = ["Version 2.0. (the License)...", "..x a..b C.", "", "...", "É licence-v3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", licenses.terms_of(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [licenses._terms(t) for t in texts]
