"""Extra columns with names that the operators use inside."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fingerprints, licenses, line_dedup, media, mixing, near_dedup, piece_codec, quality, token_counts, toxicity

NAMES = (
    "size", "row", "row_hash", "mix_hash", "mix_copies", "mix_number", "copies", "target", "taken", "node", "band", "bands", "class_id", "class_key", "text_key", "near_id",
    "near_key", "place", "label", "score", "predicted", "held_out", "quality_id", "n_lines", "n_dropped", "n_recurring", "line_no", "print", "template", "block", "guest",
    "cell", "kept_0", "its_id", "its_print", "whole", "path", "licence", "unit", "terms", "fingerprint", "media", "ids", "doc id", "x.y",
)


@pytest.fixture(scope="module")
def wide(table, prose):
    rows = [(i, f"{prose(i % 25, 40)}\nthe same last line of all of them", "en", "ab"[i % 2], 0) for i in range(40)]
    return table(rows).select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")


def test_rows_stay_whole(wide, labels):
    for out in (mixing.mixed_documents(wide), near_dedup.one_of_each(wide), line_dedup.deduped_documents(wide), quality.accepted_documents(wide, labels)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES)


def test_results_do_not_depend_on_them(wide, labels):
    bare = wide.select("doc_id", "text", "lang", "source", "n_chars")
    for run in (
        mixing.mix,
        lambda d: near_dedup.near_duplicates(d),
        fingerprints.edited_fingerprints,
        media.media_digest,
        lambda d: quality.quality_scores(d, labels),
        lambda d: licenses.scan_licenses(d, F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))),
        lambda d: piece_codec.piece_digest(d, public_tokenizers.path("piece_bpe_32k.model")),
        lambda d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        lambda d: toxicity.toxicity_scores(d, labels),
        line_dedup.line_dedup,
    ):
        assert sorted(map(repr, run(wide).collect())) == sorted(map(repr, run(bare).collect()))
