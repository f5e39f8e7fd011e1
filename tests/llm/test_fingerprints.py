import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import fingerprints as fp

TEXT = st.text("abé🙂", max_size=60)


@given(TEXT, TEXT)
@settings(max_examples=80, deadline=None)
def test_spans_and_extensions(a, b):
    x, y = fp.PrefixHashes.of(a), fp.PrefixHashes.of(b)
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    assert x.common(0, y, 0) == same
    for i in range(0, len(a), 7):
        for j in range(0, len(b), 5):
            width = min(4, len(a) - i, len(b) - j)
            assert (x.span(i, width) == y.span(j, width)) == (a[i : i + width] == b[j : j + width])
    keep, take = len(a) // 2, len(b) // 3
    joined, direct = x.joined(keep, y, take), fp.PrefixHashes.of(a[:keep] + b[:take])
    assert fp.fingerprint(joined, joined.sketch()) == fp.fingerprint(direct, direct.sketch())


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edits_equal_brute_force(spark, prose, odd_docs, no_docs, table):
    def check(df):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = fp.edited_fingerprints(df).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        return got

    check(odd_docs)
    assert fp.edited_fingerprints(no_docs).count() == 0
    check(table([(7, "alone", None, None, 5)]))
    check(table([(i * 10**15 - 9 * 10**18, prose(i, 30), None, None, 0) for i in range(90)]))
    spread = [(i, prose(i, 5), None, None, 0) for i in range(400)] + [(2**62, "far", None, None, 0), (-(2**62), "near", None, None, 0)]
    check(table(spread))
    sizes = [n for _, n in fp.with_next(table(spread)).groupBy("block").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 60  # one far id leaves the blocks as they are
    far = check(table([(i, prose(i, 300), None, None, 0) for i in range(120)]))
    assert all(0.3 < r.near_edited < 0.7 and r.near_next < 0.2 for r in far)
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprints(table([(1, "same", None, None, 0), (2, "same", None, None, 0), (3, "other", None, None, 0)])).collect()}
    assert prints[1] == prints[2] != prints[3]


def test_likeness_follows_the_shared_part(prose):
    a = prose(1, 400)
    for share in (0.25, 0.5, 0.75):
        cut = int(len(a) * share)
        x, y = (fp.PrefixHashes.of(t) for t in (a, a[:cut] + prose(2, 400)[: len(a) - cut]))
        assert abs(fp.likeness(fp.fingerprint(x, x.sketch()), fp.fingerprint(y, y.sketch())) - share) < 0.17


def test_blocks_meet_across_empty_ones_and_copies(table, prose):
    """Few distinct ids leave most blocks empty; many rows of one id, or without one, are dealt by their texts."""
    rows = [(None if i % 3 else 5, prose(i, 3), None, None, 0) for i in range(200)] + [(9, "end", None, None, 0)] * 3
    got = fp.edited_fingerprints(table(rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute([(r[0], r[1]) for r in rows])
    assert fp.with_next(table(rows)).filter("doc_id is null and not guest").select("block").distinct().count() > 4
    for n in (1, 2, 3):
        got = fp.edited_fingerprints(table(rows[:n]).coalesce(1)).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute([(r[0], r[1]) for r in rows[:n]])


def test_no_plan_node_takes_all_texts(table, prose):
    """Texts move in one range exchange; the window sees numbers of blocks only."""
    import contextlib
    import io

    out = fp.edited_fingerprints(table([(i, prose(i, 20), None, None, 0) for i in range(50)]))
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain()
    single = [line for line in shown.getvalue().splitlines() if "SinglePartition" in line]
    assert len(single) <= 1 and "text" not in "".join(single)
