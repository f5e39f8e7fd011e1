from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_and_ratio(spark):
    assert column(spark, ["  a\t\n", " b ", "", None], T.strip) == ["a", "b", "", None]
    assert column(spark, ["ab", "é", "aé", "", None], T.non_ascii_ratio) == [0.0, 1.0, 0.5, 1.0, 1.0]


def test_segments(spark):
    captions = ["x (A) one (b) two ", "only (A) here", "none", "(A) (B) end", "fig 2a left fig 3b right", "Figure 2B and Figure 3C", "  ", None]
    assert column(spark, captions, T.segments) == [["(A) one", "(b) two"], ["only (A) here"], ["none"], ["(A)", "(B) end"], ["fig 2a left", "fig 3b right"], ["Figure 2B and Figure 3C"], [""], [""]]
    assert column(spark, ["Figure 2B and Figure 3C"], lambda c: T.segments(c, ignore_case=True)) == [["Figure 2B and", "Figure 3C"]]


def test_keywords(spark):
    texts = ["An ULTRASOUND of", "axial ct scan", "a ct scan", "mri and doppler", "nothing", None]
    assert column(spark, texts, lambda c: T.keyword_case(c, T.MODALITY_KEYWORDS)) == ["ultrasound", "CT", "CT", "ultrasound", None, None]
    assert column(spark, ["ovarian breast"], lambda c: T.keyword_case(c, {})) == [None]


def pairs(spark, values, make):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, p string, r string")
    return [x.x for x in df.select("i", make(F.col("p"), F.col("r")).alias("x")).orderBy("i").collect()]


def test_answers(spark):
    assert pairs(spark, [("The modality is MRI.", "mri"), ("ct", "mri"), ("any", ""), ("É-x!", "éx")], T.clean_answer) == ["mri", "ct", "", "éx"]
    assert pairs(spark, [("any", "")], lambda p, r: T.clean_answer(p, r, guard_empty=True)) == ["any"]
    assert pairs(spark, [(" A ", "a"), ("a", "b"), (None, "a")], T.exact_match) == [1.0, 0.0, 0.0]
    assert pairs(spark, [("a a b", "a b b"), ("", "a"), (None, None), ("x", "y")], T.token_f1) == [pytest.approx(2 / 3), 0.0, 0.0, 0.0]
    assert pairs(spark, [("It's an MRI!", "mri"), ("ab", "b"), ("a-b", "A b")], T.lenient_match) == [True, False, True]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=12), st.text("ab c", max_size=12)), min_size=40, max_size=40))
def test_token_f1_equals_counts(spark, values):
    def brute(p, r):
        p, r = p.split(), r.split()
        common = sum((Counter(p) & Counter(r)).values())
        return 2 * common / (len(p) + len(r)) if p and r else 0.0

    assert pairs(spark, values, T.token_f1) == [pytest.approx(brute(p, r)) for p, r in values]
    assert pairs(spark, values, T.token_f1) == pairs(spark, values, lambda p, r: T.token_f1(r, p))


def test_candidates(spark):
    cases = [
        ("different", ["same", "different"], "different"),
        ("Reasoning... Final answer: B", ["A", "B", "none"], "B"),
        ("I cannot determine", ["0", "1", "2"], None),
        ("A or B, so A", ["A", "B"], "A"),
        ("answer: 1 final answer: 12", ["1", "2", "12"], "12"),
        ("B2 is not it", ["B"], None),
        ("B B", ["B"], "B"),
        (None, ["none"], "none"),
        ("a.b", ["a.b", "b"], "b"),
    ]
    df = spark.createDataFrame([(i, r, c) for i, (r, c, _) in enumerate(cases)], "i int, r string, c array<string>")
    got = [x.x for x in df.select("i", T.parse_candidate(F.col("r"), F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [e for _, _, e in cases]


def test_ids(spark):
    stems = ["00001-PMC5__fig1", "PMC5__fig1", "00001-PMC5", "1-a-b__c__d", None]
    assert column(spark, stems, T.key_from_stem) == ["PMC5", None, None, "a-b", None]
    assert column(spark, [0, 25, 26, 30], T.reading_label, "int") == ["A", "Z", "p26", "p30"]
    assert column(spark, ["f_a", "f_AB", "f_p26", "f"], T.panel_letter) == ["A", "AB", "f_p26", "f"]
    assert column(spark, [0.5, 1.0, None], T.percent, "double") == ["50.0", "100.0", "--"]


def test_strip_reads_long_inner_runs_once(spark):
    import time

    texts = ["a" + " " * 300_000 + "b", " \u00a0a b\u2003\n", "   ", "", None, "x\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    began = time.time()
    got = {r.i: r.s for r in df.select("i", T.strip(F.col("t")).alias("s")).collect()}
    assert time.time() - began < 20
    assert got == {i: t if t is None else t.strip() for i, t in enumerate(texts)}
