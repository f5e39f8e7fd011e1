"""Operators that read each text by itself: media, pieces, token counts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import media, piece_codec, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_container_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and payload and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    stored = media.write_container(payload)
    info = media.read_container(stored)
    assert media.stored_bytes(stored, info) == payload
    assert info["codec"] == "uncv" and info["duration"] == len(payload) // 576 and info["keys"].tolist() == list(range(0, info["duration"], media.KEY_EVERY))
    every = media.read_container(media.write_container(payload, 1))
    assert len(every["keys"]) == info["duration"]


def test_container_with_many_chunks_and_sync_table():
    payload = random.Random(1).randbytes(576 * 200)
    stored = media.write_container(payload, 7)
    info = media.read_container(stored)
    assert media.stored_bytes(stored, info) == payload
    assert {p[-1] for p, _, _ in media.walk(stored)} >= {b"ftyp", b"moov", b"trak", b"stbl", b"stsz", b"stsc", b"stco", b"stss", b"mdat"}
    assert info["keys"].tolist() == list(range(0, 200, 7))
    ranges = media.merged_ranges(info["offsets"][info["keys"]], info["sizes"][info["keys"]])
    start = stored.index(b"mdat") + 4
    assert ranges.tolist() == [[start + 576 * k, 576] for k in range(0, 200, 7)]
    assert b"".join(stored[a : a + n] for a, n in ranges.tolist()) == b"".join(payload[576 * k : 576 * k + 576] for k in range(0, 200, 7))


def patched(kind, offset, value):
    """A stored payload with four bytes changed behind the name of a box."""
    stored = bytearray(media.write_container(media.padded(b"x" * 3000)))
    at = stored.index(kind) + 4 + offset
    stored[at : at + 4] = value.to_bytes(4, "big")
    return bytes(stored)


def test_hostile_boxes():
    deep = b""
    for _ in range(5000):
        deep = (len(deep) + 8).to_bytes(4, "big") + b"moov" + deep
    assert sum(1 for _ in media.walk(deep)) == 5000 and media.read_container(deep) is None
    for kind, offset, value in ((b"stsz", 8, 2**32 - 1), (b"stsz", 4, 2**31), (b"stco", 4, 2**32 - 1), (b"stsc", 4, 2**32 - 1), (b"stsc", 12, 2**32 - 1), (b"stss", 4, 2**32 - 1), (b"stss", 8, 0), (b"stss", 8, 99), (b"stts", 8, 2**32 - 1)):
        assert media.read_container(patched(kind, offset, value)) is None, (kind, offset)
    whole = media.write_container(media.padded(b"x"))
    assert media.read_container(whole + (16).to_bytes(4, "big") + b"moof" + (8).to_bytes(4, "big") + b"traf") is None


def test_first_video_track_counts():
    stored = media.write_container(media.padded(b"y" * 2000))
    at = stored.index(b"trak") - 4
    size = int.from_bytes(stored[at : at + 4], "big")
    sound = stored[at : at + size].replace(b"vide", b"soun").replace(b"uncv", b"mp4a")
    moov = stored.index(b"moov") - 4
    both = bytearray(stored[:at] + sound + stored[at:])
    both[moov : moov + 4] = (int.from_bytes(stored[moov : moov + 4], "big") + size).to_bytes(4, "big")
    for table in (i for i in range(len(both)) if both[i : i + 4] == b"stco"):
        both[table + 12 : table + 16] = (int.from_bytes(both[table + 12 : table + 16], "big") + size).to_bytes(4, "big")
    info = media.read_container(bytes(both))
    assert info["codec"] == "uncv" and media.stored_bytes(bytes(both), info) == media.padded(b"y" * 2000)


def expected_digest(doc_id, text):
    """The digest's row without the operator's reader: the places follow from the format."""
    raw = (text or "").encode()
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    stored = media.write_container(payload)
    start, frames = len(stored) - len(payload), len(payload) // 576
    keys = [(start + 576 * k, 576) for k in range(0, frames, 12)]
    crc = zlib.crc32(b"".join(stored[a : a + n] for a, n in keys))
    table = hashlib.sha256(b"".join(v.to_bytes(8, "big") for pair in keys for v in pair)).hexdigest()[:16]
    feature = f"codec=uncv;size=24x24;seconds={frames / 25:.2f};samples={frames};keyframes={len(keys)};ranges={len(keys)}:{table};crc={crc:08x}"
    return (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)


def test_digest_equals_brute_force(odd_docs):
    expected = sorted((expected_digest(r.doc_id, r.text) for r in odd_docs.collect()), key=repr)
    assert sorted((tuple(r) for r in media.media_digest(odd_docs).collect()), key=repr) == expected


@pytest.mark.parametrize("data", [None, b"", b"no box at all", b"\x00\x00\x00\x08moov", media.write_container(media.padded(b"x"))[:-300]])
def test_malformed_media(data):
    assert media.read_container(data) is None


def test_media_queries(spark, odd_docs, no_docs):
    rows = media.media_digest(odd_docs).collect()
    assert len(rows) == 10 and media.media_digest(no_docs).count() == 0
    by_text = {(r.doc_id, r.n_bytes): r for r in rows}
    empty = by_text[(1, 0)]
    payload = b"\xff" * 576
    assert (empty.payload_bytes, empty.payload_sha256, empty.tail_crc32) == (576, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    held = media.text_media(odd_docs)
    told = {r.doc_id: r for r in media.media_columns(held.filter("doc_id = 2"), "doc_id", "media").collect()}[2]
    assert told.n_keyframes == len(told.keyframe_ranges) == -(-told.n_samples // 12) and {r.length for r in told.keyframe_ranges} == {576}
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [r.codec for r in media.media_columns(broken, "doc_id", "media").collect()] == [None, None]


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


PARTS = ["a", "b", " ", "  ", "\n", "▁", "é", "the", "ing", "1", "!", "　", "\t", "漢", "🙂", "<s>", "<0x0A>", "\x00", " t", "he", "bab", "aaa", "---", "    ", "https://www.", "\r\n"]


def test_pieces_equal_the_library(pieces):
    ours, library = pieces
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(2000)] + [" " * k for k in range(130)] + ["a" * k for k in range(60)]
    assert [x.tolist() for x in ours.encode(texts)] == library.encode(texts)
    ids = [[1, *x, 2] for x in library.encode(texts)]
    assert ours.decode([np.array(x) for x in ids]) == [library.decode(x) for x in ids]


def test_long_runs_without_a_cut(pieces):
    ours, library = pieces
    rng = random.Random(5)
    texts = ["the" * n for n in (64, 65, 66, 5000, 100_000)] + ["ing" * 20_000, "a" * 100_001, "the" * 300 + "x" + "ing" * 300, "".join(rng.choices(["the", "in", "g", "er", "s"], k=40_000))]
    texts += ["".join(rng.choices(["the", "th", "e", "ing", "he", "er", "an", "on", "▁"], k=rng.randint(1, 900))) for _ in range(100)]
    assert [x.tolist() for x in ours.encode(texts)] == library.encode(texts)


def test_every_piece_and_random_ids(pieces):
    ours, library = pieces
    names = [library.id_to_piece(i) for i in range(259, 32000)]
    rng = random.Random(4)
    texts = [a + b for a, b in zip(names, rng.sample(names, len(names)), strict=True)]
    assert [x.tolist() for x in ours.encode(texts)] == library.encode(texts)
    ids = [[rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(12)] for _ in range(500)]
    assert ours.decode([np.array(x) for x in ids]) == [library.decode(x) for x in ids]


def test_piece_queries(spark, pieces, odd_docs, no_docs):
    _, library = pieces
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    rows = piece_codec.piece_digest(odd_docs, PIECES).collect()
    expected = []
    for i, t in texts:
        ids = [1, *library.encode(t), 2]
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in rows) == sorted(expected)
    assert piece_codec.piece_digest(no_docs, PIECES).count() == 0
    back = piece_codec.piece_texts(piece_codec.piece_ids(odd_docs.filter("doc_id = 3"), PIECES), PIECES)
    assert sorted(r.text for r in back.collect()) == sorted(t for i, t in texts if i == 3)


@pytest.fixture(scope="module")
def counting():
    library = Tokenizer.from_file(BPE)
    return token_counts.counter(BPE), lambda t: len(library.encode(t, add_special_tokens=False).ids)


LETTERS = ["a", "b", " ", "  ", "\n", "'", "'ll", "'re", "é", "<|endoftext|>", "the", "ing", "1", "!", "　", "\t", "漢", "\x1c"]


def test_every_prefix_has_its_exact_count(counting):
    ours, count = counting
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 9)))
        prefixes = ours.prefixes(text)
        assert [int(prefixes[len(text[:i].encode())]) for i in range(len(text) + 1)] == [count(text[:i]) for i in range(len(text) + 1)], text


def test_every_character(counting):
    ours, count = counting
    for code in [*range(0x3100), *range(0xA000, 0xD7FF, 13), *range(0x1F300, 0x1F700, 7)]:
        text = f"a{chr(code)} b"
        assert ours.count(text, 10**9) == (count(text), len(text)), hex(code)


def test_budgets_end_at_any_character(counting):
    ours, count = counting
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choices([*LETTERS, "unbelievable", " strengthening", "漢字", "🙂"], k=rng.randint(0, 12)))
        limit = rng.randint(0, 8)
        assert ours.count(text, limit) == (count(text), max(i for i in range(len(text) + 1) if count(text[:i]) <= limit)), (text, limit)


def test_token_queries(spark, counting, odd_docs, no_docs):
    _, count = counting
    rows = token_counts.token_counts(odd_docs, BPE).collect()
    expected = [(r.doc_id or 0, len((r.text or "").encode()), count(r.text or "")) for r in odd_docs.collect()]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == sorted(expected)
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    long = next(r for r in rows if r.doc_id == 2)
    text = odd_docs.filter("doc_id = 2").first().text
    assert count(text[: long.fitting_chars]) <= 512 < min(count(text[: long.fitting_chars + k]) for k in range(1, 30))
    assert token_counts.token_counts(no_docs, BPE).count() == 0
    held = token_counts.prefix_counts(odd_docs.filter("doc_id = 3"), BPE).first()
    assert held.counts[0] == 0 and len(held.counts) > 30
