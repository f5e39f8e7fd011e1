import pytest

from corpusmill.operators import evaluate


def test_scores_leave_errors_out(spark):
    rows = [("m", "modality", "It is MRI.", "mri"), ("m", "modality", "ct", "mri"), ("m", "modality", "[ERROR: x]", "mri"), ("m", "modality", None, "mri"), ("m", "panel_count", "3", "3"), ("m", "anatomy", "left breast", "breast tissue")]
    df = spark.createDataFrame(rows, "model string, question_type string, prediction string, reference string")
    got = {r.question_type: (r.n, r.n_errors, r.exact_match, r.token_f1) for r in evaluate.score_predictions(df, ["model"]).collect()}
    assert got == {"modality": (2, 2, 0.5, 0.5), "anatomy": (1, 0, 0.0, 0.5), None: (3, 2, pytest.approx(1 / 3), 0.5)}


def test_derived_answers(spark):
    ids = ["f_a", "f_b", "f_c"]
    questions = [
        ("1", ids, "Do panels A and B show the same imaging modality?", "modality_same_different"),
        ("2", ids, "Do panels A and C show the same imaging modality?", "modality_same_different"),
        ("3", ids, "How many panels show MRI?", "modality_count"),
        ("4", ids, "Which panel shows a different anatomical structure than the others?", "anatomy_odd_one_out"),
        ("5", ["f_a", "g_x"], "How many panels show MRI?", "modality_count"),
        ("6", ["h_a", "h_b"], "Which panel shows a different anatomical structure than the others?", "anatomy_odd_one_out"),
    ]
    tags = [("f_a", "modality", "CT", 0), ("f_a", "modality", "MRI", 1), ("f_b", "modality", "MRI", 0), ("f_c", "modality", "CT", 0)]
    tags += [("f_a", "anatomy", "breast", 0), ("f_b", "anatomy", "ovary", 0), ("f_c", "anatomy", "breast", 0), ("h_a", "anatomy", "x", 0), ("h_b", "anatomy", "x", 0)]
    q = spark.createDataFrame(questions, "question_id string, panel_ids array<string>, question string, question_type string")
    t = spark.createDataFrame(tags, "panel_id string, tag_type string, tag string, seq int")
    got = {r.question_id: r.prediction for r in evaluate.derive_answers(q, t).collect()}
    assert got == {"1": "same", "2": "different", "3": "2", "4": "B", "5": None, "6": "none"}


def test_accounting_and_tables(spark):
    rows = [("d", "t", "modality_count", "1", "1"), ("d", "t", "modality_count", "1", "2"), ("d", "t", "anatomy_odd_one_out", "A", None)]
    df = spark.createDataFrame(rows, "method string, track string, question_type string, answer string, prediction string")
    got = {r.question_type: (r.n_evaluated, r.n_excluded, r.accuracy) for r in evaluate.accounting(df, ["question_type"]).collect()}
    assert got == {"modality_count": (2, 0, 0.5), "anatomy_odd_one_out": (0, 1, None)}
    row = evaluate.ablation_table(df).first()
    assert (row.n_evaluated, row.n_excluded, row.overall, row.anatomy_odd_one_out) == (2, 1, 0.5, None)
    tidy = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0), ("n", "a", 3.0)], "metric string, track string, value double")
    assert {r.metric: (r.a, r.b) for r in evaluate.compare_tracks(tidy, ["a", "b"]).collect()} == {"m": (1.0, 2.0), "n": (3.0, None)}
