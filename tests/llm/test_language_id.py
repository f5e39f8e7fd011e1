import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import language_id as li


def spelled(text):
    """The n-grams by the definition: letters in lower case, blanks for the rest, none across two blanks."""
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    found = {s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)}
    return {g for g in found if "  " not in g and g != " "}


def test_cells_are_those_of_all_grams(monkeypatch):
    texts = ["Ab, ba!  Çela été.", "x", "aa" * 50, "one two\n\nthree", "日本語 text", "a-b--c"]
    for text in texts:
        cells = li.gram_cells(text)
        assert len(cells) == len(set(cells.tolist())) == len(spelled(text))  # no two of so few grams share a cell
        monkeypatch.setattr(li, "WINDOW", 5)
        assert set(li.gram_cells(text).tolist()) == set(cells.tolist())
        monkeypatch.undo()
    assert li.gram_cells("") is None and li.gram_cells("12 -- 3") is None


def test_kernel_and_batched_scores_equal_plain_sums():
    texts = ["the cat sat on the mat", "le chat est assis", "die katze sitzt auf der matte", "a", "the the", "un chat et une katze"]
    marks = li.Landmarks([li.gram_cells(t) for t in texts[:3]])
    for t in texts:
        want = [len(spelled(t) & spelled(m)) / math.sqrt(len(spelled(t)) * len(spelled(m))) for m in texts[:3]]
        assert np.allclose(marks.kernel(li.gram_cells(t)), want)
    alpha = np.random.default_rng(1).normal(size=(3, 2))
    held = np.add.reduceat((alpha / np.sqrt(marks.sizes)[:, None])[marks.owner], marks.begins[:-1], axis=0)
    place = np.full(1 << li.CELL_BITS, len(held), np.int32)
    place[marks.known] = np.arange(len(held))
    model = li.LanguageModel(["x", "y"], place, np.vstack([held, np.zeros((1, 2))]).astype(np.float32))
    sets = [li.gram_cells(t) for t in texts]
    assert np.allclose(model.scores(sets), np.array([marks.kernel(s) for s in sets]) @ alpha, atol=1e-5)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.language_scores(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    # labels of the held-out fold are never read
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, li.language_scores(hidden).collect())) == sorted(map(tuple, got.collect()))


def test_odd_rows(odd_docs, no_docs, table, prose):
    rows = [(i, prose(i % 3, 20), "en" if i % 3 else None, "s", 0) for i in range(30)] + [(i, "été çà où " * 5, "fr", "s", 0) for i in range(30, 60)]
    odd = [(None, "été", "fr", "s", 0), (70, "12 -", "en", None, 0), (71, None, None, None, None), (71, "ou", None, None, None), (72, "é" * 2_100_000, "fr", "s", 0)]
    got = li.language_scores(table(rows + odd).withColumn("lang_pred", F.lit(1)).withColumn("turn", F.lit(2)))
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[70][0].lang_pred == "und" and by_id[70][0].score == 0
    assert sorted(r.lang_pred for r in by_id[71])[1] == "und" and len(by_id[71]) == 2
    assert by_id[None][0].lang_pred == "fr" and by_id[None][0].held_out is False
    assert by_id[72][0].lang_pred == "fr"
    assert li.language_scores(no_docs).collect() == []
    assert len(li.language_scores(odd_docs).collect()) == odd_docs.count()
    unlabelled = table([(1, "some text", None, "s", 0), (2, None, None, "s", 0)])
    assert {r.lang_pred for r in li.language_scores(unlabelled).collect()} == {"und"}


def test_rare_languages_are_all_in_the_sample(table):
    rows = [(i, f"common words {i}", "en", "s", 0) for i in range(3000)] + [(i, f"selten {i}", "de", "s", 0) for i in range(3000, 3012)]
    sample = li.labelled_texts(table(rows), "doc_id", "text", "lang", 100).collect()
    usable = [i for i in range(3000, 3012) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(sample) == 100 and sum(r.lang == "de" for r in sample) == len(usable)
