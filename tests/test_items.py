import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import align, boxes, datasets, quality, retrieval


def assign(spark, panels, segs):
    p = spark.createDataFrame([("f", f"p{i}", [float(x) for x in v]) for i, v in enumerate(panels)], "figure_id string, panel_id string, embedding array<double>")
    s = spark.createDataFrame([("f", i, t, [float(x) for x in v]) for i, (t, v) in enumerate(segs)], "figure_id string, seg_idx int, text string, embedding array<double>")
    return {r.panel_id: (r.assigned_segment_text, r.alignment_mode, r.assigned_similarity) for r in align.assign(p, s).collect()}


def test_distinct(spark):
    got = assign(spark, np.eye(3), [("seg_A", (1, 0.1, 0)), ("seg_B", (0, 1, 0.1)), ("seg_C", (0.1, 0, 1))])
    assert {k: v[:2] for k, v in got.items()} == {f"p{i}": (f"seg_{c}", "assigned_distinct") for i, c in enumerate("ABC")}


def test_argmax_would_collapse(spark):
    got = assign(spark, [(1, 0), (0.9, 0.1)], [("popular_seg", (1, 0)), ("other_seg", (0.3, 0.95))])
    assert {v[0] for v in got.values()} == {"popular_seg", "other_seg"}


def test_shared_none_and_floor(spark):
    assert {v[1] for v in assign(spark, [(1, 0), (0.9, 0.1), (0.8, 0.2)], [("only_caption", (1, 0))]).values()} == {"shared_caption"}
    assert assign(spark, [(1, 0)], []) == {"p0": (None, "no_candidate_text", None)}
    text, mode, sim = assign(spark, [(1, 0)], [("weak", (0.05, 0.999))])["p0"]
    assert (text, mode) == (None, "unmatched") and sim == pytest.approx(0.05)


def test_insufficient(spark):
    got = assign(spark, [(1, 0, 0), (0, 1, 0), (0, 0.9, 0.1)], [("a", (1, 0, 0)), ("b", (0, 1, 0))])
    assert [got[f"p{i}"][1] for i in range(3)] == ["assigned_distinct", "assigned_distinct", "shared_segment_insufficient"]
    assert got["p2"][0] == "b"


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 6)
        m = rng.integers(n, 7)
        sim = np.round(rng.normal(size=(n, m)), rng.integers(0, 3))
        got = align.best_assignment(sim)
        assert len(set(got.tolist())) == n
        best = max(sum(sim[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(m), int(n)))
        assert sim[np.arange(n), got].sum() == pytest.approx(best)


def test_figure_modes(spark):
    rows = [("a", "assigned_distinct"), ("a", "shared_segment_insufficient"), ("b", "assigned_distinct"), ("c", "shared_caption"), ("d", "no_candidate_text"), ("e", "unmatched")]
    got = {r.figure_id: r.figure_mode for r in align.figure_modes(spark.createDataFrame(rows, "figure_id string, alignment_mode string")).collect()}
    assert got == {"a": "partially_shared", "b": "fully_distinct", "c": "shared_caption", "d": "no_candidate_text", "e": "other"}


PANEL = "figure_id string, panel_id string, modality_tag string, anatomy_tag string, split string"


def questions(spark, modality, anatomy, splits=None):
    rows = [("f", f"f_{chr(97 + i)}", m, a, (splits or ["train"] * 9)[i]) for i, (m, a) in enumerate(zip(modality, anatomy, strict=True))]
    return datasets.cross_panel_questions(spark.createDataFrame(rows, PANEL))


def test_all_question_types(spark):
    rows = questions(spark, ["MRI", "MRI", "CT"], ["breast", "breast", "ovary"]).collect()
    kinds = [r.question_type for r in rows]
    assert kinds.count("modality_same_different") == 2 and kinds.count("modality_count") == 2
    assert [r.answer for r in rows if r.question_type == "anatomy_odd_one_out"] == ["C"]
    pairs = {r.answer: r.question for r in rows if r.question_type == "modality_same_different"}
    assert pairs["same"].startswith("Do panels A and B") and pairs["different"].startswith("Do panels A and C")
    spaced = {r.question_type: r.answer_space for r in datasets.with_answer_space(questions(spark, ["MRI", "MRI", "CT"], ["breast", "breast", "ovary"])).collect()}
    assert spaced == {"modality_same_different": ["same", "different"], "anatomy_odd_one_out": ["A", "B", "C", "none"], "modality_count": ["0", "1", "2", "3"]}


@pytest.mark.parametrize(("modality", "anatomy"), [(["MRI", None], [None, None]), (["MRI", None, None], [None] * 3)])
def test_ineligible(spark, modality, anatomy):
    assert questions(spark, modality, anatomy).count() == 0


def test_only_available_pairs(spark):
    def answers(modality):
        return [r.answer for r in questions(spark, modality, ["breast"] * 3).filter("question_type = 'modality_same_different'").collect()]

    assert answers(["MRI"] * 3) == ["same"] and answers(["MRI", "CT", "X-ray"]) == ["different"]
    assert questions(spark, ["MRI"] * 4, ["breast", "breast", "ovary", "uterus"]).filter("question_type = 'anatomy_odd_one_out'").count() == 0


def test_split_leak_raises(spark):
    with pytest.raises(Exception, match="split leakage"):
        questions(spark, ["MRI"] * 3, ["breast"] * 3, ["train", "train", "test"]).collect()


def test_quality_boundaries(spark):
    def flags(**changes):
        row = {"width": 100, "height": 100, "aspect_ratio": 1.0, "best_similarity": 0.5, "similarity_margin": 0.1, "n_candidate_segments": 2, "match_type": "panel_specific"} | changes
        schema = "width int, height int, aspect_ratio double, best_similarity double, similarity_margin double, n_candidate_segments int, match_type string"
        r = quality.quality_flags(spark.createDataFrame([tuple(row.values())], schema)).first()
        return r.quality_flags, r.is_flagged

    assert flags() == ([], False)
    assert flags(width=31) == (["panel_too_small"], True) and flags(width=32) == ([], False)
    assert flags(aspect_ratio=8.0) == ([], False) and flags(aspect_ratio=8.01) == (["extreme_aspect_ratio"], True)
    assert flags(aspect_ratio=0.125) == ([], False) and flags(aspect_ratio=float("nan")) == ([], False)
    assert flags(best_similarity=0.18) == ([], False) and flags(best_similarity=0.1799) == (["low_clip_similarity"], True)
    assert flags(best_similarity=None) == (["missing_alignment"], True) and flags(best_similarity=float("nan")) == (["missing_alignment"], True)
    assert flags(similarity_margin=0.01) == ([], False) and flags(similarity_margin=0.0099) == (["ambiguous_alignment"], True)
    assert flags(similarity_margin=0.0, n_candidate_segments=1) == ([], False)
    assert flags(match_type="figure_level_caption") == (["figure_level_caption_only"], False)


def order(spark, rows):
    schema = "f string, x1 double, y1 double, x2 double, y2 double, h double"
    df = spark.createDataFrame([("f", *r) for r in rows], schema)
    return [(r.x1, r.y1, r.label) for r in boxes.reading_order(df, "f", "x1", "y1", "x2", "y2", "h", []).orderBy("position").collect()]


def test_reading_order(spark):
    grid = [(50.0, 11.0, 90.0, 40.0, 100.0), (0.0, 0.0, 40.0, 40.0, 100.0), (0.0, 60.0, 40.0, 90.0, 100.0), (50.0, 55.0, 90.0, 90.0, 100.0)]
    assert [x[2] for x in order(spark, grid)] == list("ABCD")
    assert [(x, y) for x, y, _ in order(spark, grid)] == [(0.0, 0.0), (50.0, 11.0), (0.0, 60.0), (50.0, 55.0)]
    assert order(spark, [(i * 1.0, 0.0, i + 1.0, 1.0, 9.0) for i in range(27)])[-1][2] == "p26"


def test_reading_order_equals_greedy_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a + 5), float(b + 5), 100.0) for a, b in rng.permutation(400)[:24].reshape(12, 2)]
    groups: dict[int, list] = {}
    for box in sorted(rows, key=lambda r: r[1] + r[3]):
        near = [g for g, held in groups.items() if abs((box[1] + box[3]) / 2 - np.mean([h[1] + h[3] for h in held]) / 2) < 12]
        groups.setdefault(min(near, default=len(groups)), []).append(box)
    lines = list(groups.values())
    expected = [(r[0], r[1]) for line in lines for r in sorted(line)]
    assert [(x, y) for x, y, _ in order(spark, rows)] == expected


def test_polygons(spark):
    rows = [("k", 100, 50, [([[10.0, 10.0], [30.0, 20.0]],), ([[90.0, 40.0], [200.0, 80.0]],), ([[5.0, 5.0], [5.0, 9.0]],)])]
    df = spark.createDataFrame(rows, "k string, width int, height int, subfigures array<struct<points: array<array<double>>>>")
    got = [tuple(r)[1:] for r in boxes.polygons_to_boxes(df, ["k"]).orderBy("box_no").collect()]
    assert got == [(0, 0.2, 0.3, 0.2, 0.2), (1, 0.95, 0.9, pytest.approx(0.1), 0.2)]


def test_box_lines(spark):
    lines = ["0 0.5 0.5 0.2 0.049", "0 0.5 0.5 0.2", "0 a 0.5 0.2 0.1", "0 0.5 0.5 0 0.1", "0 1.5 0.5 0.1 0.1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").select("i", boxes.parse_box_line(F.col("l")).alias("b"))
    got = df.select("i", F.col("b").isNotNull().alias("parsed"), boxes.valid_box(F.col("b.cx"), F.col("b.cy"), F.col("b.bw"), F.col("b.bh")).alias("valid"), boxes.tiny_box(F.col("b.bw"), F.col("b.bh")).alias("tiny")).orderBy("i").collect()
    assert [(r.parsed, r.valid) for r in got] == [(True, True), (False, False), (False, False), (True, False), (True, False)] and got[0].tiny


def test_retrieval_in_tiles_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(90, 4)), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    sims = np.round(v @ v.T, 6)
    expected = {(i, int(j)): p + 1 for i in range(90) for p, j in enumerate([j for j in np.lexsort((np.arange(90), -sims[i])) if j != i][:7])}
    assert {(r["query"], r.neighbour): r.place for r in retrieval.topk(df, df, 7, block=25).collect()} == expected
    ranks = retrieval.rank_of_truth(df.withColumn("truth", (F.col("id") + 1) % 90), df, "truth", block=25)
    brute = {i: 1 + sum((sims[i, j], -j) > (sims[i, t], -t) for j in range(90)) for i in range(90) for t in [(i + 1) % 90]}
    assert {r["query"]: r["rank"] for r in ranks.collect()} == brute
    recall = {r.k: r.recall for r in retrieval.recall_at(ranks, (1, 45)).collect()}
    assert recall == {k: pytest.approx(np.mean([b <= k for b in brute.values()])) for k in (1, 45)}


def test_pool_and_padding(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", None)], "g string, embedding array<double>")
    assert datasets.mean_pool(df, "g").first().pooled == [2.0, 3.0]
    assert datasets.mean_pool(df.orderBy(F.desc("embedding")), "g").first().pooled == [2.0, 3.0]
    row = spark.createDataFrame([([[1.0], [2.0]],)], "v array<array<double>>").select(datasets.padded(F.col("v"), 3, 1).alias("p")).first().p
    assert row["values"] == [[1.0], [2.0], [0.0]] and row["mask"] == [False, False, True]


def test_label_space(spark):
    df = spark.createDataFrame([("t", ["10", "none"]), ("t", ["2", "B"])], "t string, l array<string>")
    assert datasets.label_space(df, "t", "l").first().l == ["2", "10", "B", "none"]


def test_vqa_rows(spark):
    df = spark.createDataFrame([(1, " MRI of the breast ", 4), (2, "", None), (3, None, 2)], "i int, best_match_text string, panels_in_figure int")
    got = sorted((r.i, r.question_type, r.answer) for r in datasets.vqa_rows(df, ["i"]).collect())
    assert got == [(1, "anatomy", "breast"), (1, "modality", "MRI"), (1, "panel_caption", "MRI of the breast"), (1, "panel_count", "4"), (3, "panel_count", "2")]
