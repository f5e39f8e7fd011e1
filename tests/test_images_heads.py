import struct
import zlib

import numpy as np
import pytest

from corpusmill.operators import heads
from corpusmill.sources import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, filters=None):
    """An 8-bit grey or colour PNG; ``filters`` gives each row's filter."""
    height, width, channels = pixels.shape
    flat = pixels.reshape(height, -1).astype(int)
    rows = b""
    for y in range(height):
        kind = (filters or [0])[y % len(filters or [0])]
        left = np.concatenate([np.zeros(channels, int), flat[y][:-channels]])
        up = flat[y - 1] if y else np.zeros_like(flat[y])
        corner = np.concatenate([np.zeros(channels, int), up[:-channels]])
        base = left + up - corner
        near = np.select([(abs(base - left) <= abs(base - up)) & (abs(base - left) <= abs(base - corner)), abs(base - up) <= abs(base - corner)], [left, up], corner)
        guess = [np.zeros_like(left), left, up, (left + up) // 2, near][kind]
        rows += bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return images.PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters(channels):
    pixels = np.random.default_rng(1).integers(0, 256, (30, 17, channels))
    gray = images._png(png(pixels, [0, 1, 2, 3, 4]))["gray"]
    expected = pixels[..., 0] if channels == 1 else pixels[..., :3] @ np.array([0.299, 0.587, 0.114])
    assert np.allclose(gray, expected)


def test_integrity(spark):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:300, 0:260]
    waves = [np.cos(np.pi * i * y / 300) * np.cos(np.pi * j * x / 260) * rng.normal() for i in range(8) for j in range(8)]
    photo = np.clip(127 + 12 * sum(waves), 0, 255)[..., None].astype(int)
    near, far = np.clip(photo + rng.integers(-4, 5, photo.shape), 0, 255), rng.integers(0, 256, photo.shape)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 40, 500, 1) + b"\x01\x11\x00\xff\xda\x00\x02data\xff\xd9"
    files = {"a": png(photo), "b": png(near), "c": png(far), "cut": png(photo)[:-20], "j": jpeg, "k": jpeg[:-2], "g": b"GIF89a" + struct.pack("<HH", 9, 8) + b"xx;", "t": b"plain text", "n": None}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r.path: r for r in images.inspect_images(df).collect()}
    assert {p for p, r in got.items() if r.openable} == {"a", "b", "c", "j", "g"}
    assert (got["a"].width, got["a"].height, got["a"].mode, got["a"].is_low_res) == (260, 300, "L", False) and got["j"].is_low_res
    assert got["cut"].sha256 and got["cut"].error.startswith("decode_error") and got["n"].error.startswith("read_error")
    distance = lambda p, q: bin((got[p].phash ^ got[q].phash) & (2**64 - 1)).count("1")
    assert distance("a", "b") <= 12 < distance("a", "c")


def test_padding_and_order():
    rng = np.random.default_rng(3)
    panels, question = rng.normal(size=(2, 3, 4)), rng.normal(size=(2, 4))
    empty = np.array([[False, False, True]] * 2)
    changed, swapped = panels.copy(), panels[:, [1, 0, 2]]
    changed[:, 2] += 100
    attention = heads.SetAttention(4)
    for make in (heads.mean_pool, attention):
        assert np.allclose(make(panels, question, empty), make(changed, question, empty))
    assert np.allclose(heads.mean_pool(panels, question, empty), heads.mean_pool(swapped, question, empty))
    assert not np.allclose(attention(panels, question, empty), attention(swapped, question, empty))
    assert np.isfinite(attention(panels, question, np.ones((2, 3), bool))).all()


@pytest.mark.parametrize("mode", ["mean", "attention"])
def test_heads_learn(spark, mode):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        sign = 1 if i % 2 else -1
        vectors = (rng.normal(size=(rng.integers(2, 5), 4)) * 0.3 + sign * 2).tolist()
        rows.append((i, "t", "yes" if sign > 0 else "no", vectors, [1.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "id int, question_type string, answer string, panels array<array<double>>, question_vector array<double>")
    got = heads.fit_heads(df.filter("id < 120"), df.filter("id >= 120"), "id", ["t", "none"], mode).collect()
    assert len(got) == 40 and np.mean([r.answer == r.prediction for r in got]) > 0.9


@pytest.mark.parametrize("mode", ["mean", "attention"])
def test_gradients_equal_differences(mode):
    rng = np.random.default_rng(5)
    panels, question = rng.normal(size=(5, 3, 4)), rng.normal(size=(5, 4))
    empty = np.array([[False, False, True], [False] * 3, [True] * 3, [False, True, True], [False] * 3])
    kinds, labels = np.array(["a", "b", "a", "b", "a"]), np.array([0, 2, 1, 1, 0])
    network = heads.Network(4, {"a": ["x", "y"], "b": ["p", "q", "r"]}, mode, hidden=6)
    _, by = network.loss(panels, question, empty, kinds, labels)
    assert by.keys() == network.weights.keys()
    for name, w in network.weights.items():
        for place in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]:
            kept, around = w[place], []
            for moved in (1e-5, -1e-5):
                w[place] = kept + moved
                around.append(network.loss(panels, question, empty, kinds, labels)[0])
            w[place] = kept
            assert abs((around[0] - around[1]) / 2e-5 - by[name][place]) < 1e-6, name


def test_trained_attention_answers_by_the_question(spark):
    # the answer is the sign of the panel that the question points at: the mean of a set cannot tell it
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        asked, signs = int(rng.integers(0, 2)), rng.choice([-1, 1], 2)
        vectors = np.zeros((2, 6))
        vectors[[0, 1], [0, 1]], vectors[:, 2] = 2, 2 * signs
        rows.append((i, "t", "plus" if signs[asked] > 0 else "minus", vectors[rng.permutation(2)].tolist(), np.eye(6)[asked].tolist()))
    odd = [(600, "new", "plus", [[1.0] * 6], [1.0] * 6), (601, None, "plus", [[1.0] * 6], [1.0] * 6), (602, "t", None, None, [1.0] * 6), (603, "t", "plus", [[1.0] * 6], None), (604, "t", "plus", [[1.0] * 6] * 40, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "id int, question_type string, answer string, panels array<array<double>>, question_vector array<double>")
    train, test = df.filter("id < 480"), df.filter("id >= 480")
    right = {}
    for mode in ("mean", "attention"):
        got = {r.id: r for r in heads.train_heads(train, test, "id", mode, hidden=32, rate=5e-3).collect()}
        assert set(got) == set(range(480, 605))
        right[mode] = np.mean([got[i].prediction == got[i].answer for i in range(480, 600)])
        assert [got[i].prediction is None for i in range(600, 605)] == [True, True, False, True, True]
    assert right["attention"] > 0.95 > 0.9 > right["mean"]
    assert [r.prediction for r in heads.train_heads(train.limit(0), test.filter("id = 480"), "id").collect()] == [None]


def answer_rows(spark, n=240, seed=3):
    """Sets whose answer is the panel nearest to the question, and a second type that asks for the sign of the first number."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        panels = [rng.normal(size=6).round(3).tolist() for _ in range(int(rng.integers(0, 4)))]
        question = rng.normal(size=6).round(3).tolist()
        kind = "sign" if i % 3 else "first"
        answer = ("pos" if question[0] > 0 else "neg") if kind == "sign" else ("big" if question[1] > 0.3 else "small")
        rows.append((i, kind, answer, panels, question))
    return spark.createDataFrame(rows, "key long, question_type string, answer string, panels array<array<double>>, question_vector array<double>")


@pytest.mark.parametrize("mode", ["mean", "attention"])
def test_gradients_of_any_partitioning_agree(spark, mode):
    df = answer_rows(spark)
    rows = sorted(df.collect())
    spaces = {"first": ["big", "small"], "sign": ["neg", "pos"]}
    network = heads.Network(6, spaces, mode, hidden=8)
    panels, empty = heads.pad_sets([r.panels for r in rows], 6)
    labels = np.array([spaces[r.question_type].index(r.answer) for r in rows])
    loss, by = network.loss(panels, np.array([r.question_vector for r in rows]), empty, np.array([r.question_type for r in rows]), labels)
    for parts in (1, 8):
        total, n, summed = heads.gradient_sums(df.repartition(parts), network, 6)
        assert n == len(rows) and abs(total / n - loss) < 1e-9
        assert all(np.abs(summed[name] / n - by[name]).max() < 1e-9 for name in by)


def test_training_on_all_rows_learns_and_handles_odd_rows(spark):
    df = answer_rows(spark)
    network, losses = heads.train_network_on_all(df.filter("key < 200"), hidden=16, steps=25, rate=3e-2)
    assert losses[-1] < 0.5 * losses[0]
    odd = spark.createDataFrame(
        [(900, None, "x", [[1.0] * 6], [1.0] * 6), (901, "unknown", "x", [], [1.0] * 6), (902, "sign", None, None, [1.0] * 6), (903, "sign", "pos", [[1.0] * 6] * 33, [1.0] * 6), (904, "sign", "pos", [], None)], df.schema
    )
    got = {r.key: r for r in heads.predict_heads(df.filter("key >= 200").unionByName(odd), network, ["key", "question_type", "answer"]).collect()}
    assert len(got) == 45
    assert sum(r.answer == r.prediction for k, r in got.items() if k < 900) >= 32
    assert got[902].prediction == "pos" and all(got[k].prediction is None for k in (900, 901, 903, 904))
    assert heads.train_network_on_all(odd.filter("key < 0")) == (None, [])
