"""Ids that are no numbers stay as they are."""

import public_tokenizers

from corpusmill.llm import fingerprints, media, piece_codec, token_counts


def test_text_ids_are_kept(spark):
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([("b-2", "two words"), ("a-1", "one"), (None, None)], "name string, text string")
    same = docs.selectExpr("cast(2 as int) as name", "text").limit(1)
    for operator in (
        fingerprints.edited_fingerprints,
        fingerprints.fingerprints,
        media.media_digest,
        media.text_media,
        lambda d, i: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json"), id_col=i),
        lambda d, i: token_counts.prefix_counts(d, public_tokenizers.path("byte_bpe_50k.json"), id_col=i),
        lambda d, i: piece_codec.piece_digest(d, pieces, i),
        lambda d, i: piece_codec.piece_ids(d, pieces, i),
        lambda d, i: piece_codec.piece_texts(piece_codec.piece_ids(d, pieces, i), pieces),
    ):
        out = operator(docs, "name")
        assert {r.doc_id for r in out.collect()} == {"b-2", "a-1", None}
        assert operator(same, "name").schema["doc_id"].dataType.simpleString() == "bigint"
    after = {r.doc_id: r.common_next for r in fingerprints.edited_fingerprints(docs, "name").collect()}
    assert after[None] == after["a-1"] == after["b-2"] == 0
