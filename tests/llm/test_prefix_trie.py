import hashlib
import math
import re
import zlib

import duckdb

from corpusmill.llm import prefix_trie as pt
from tests.support import assert_same, duck

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every prefix of every rebuilt conversation, straight from the definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]  # the remainder has the sign of c, as in SQL
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    name = {p: (min(m), len(p)) for p, m in members.items()}
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out[name[p]] = (name[p[:-1]][0] if p else None, len(m), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def check(df):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = pt.conversation_trie(df).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got)
    assert found == brute(rows)
    return found


def test_given_conversations_equal_brute_force_and_sql(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    check(df)
    assert_same(pt.conversation_trie(df), duck(small).sql(pt.conversation_trie_sql()))


def test_common_starts_nulls_ties_and_long_conversations(table):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"common turn {t}" if t < c % 6 else f"own {c} {t}") for c in range(45) for t in range(c % 9 + 1)]
    rows += [(100 + c, t, "user", f"the same turn {t}") for c in range(30) for t in range(7)]  # a hot group of copies
    rows += [(1000, t, None, f"w {t % 3}") for t in range(41)] + [(1001, t, None, f"w {t % 3}") for t in range(37)]
    rows += [(1001, None, None, None), (1002, 3, None, None), (1002, 3, "", ""), (1002, 3, "a", "x"), (None, 1, "a", "b"), (-7, 0, "user", "negative " * 5000)]
    found = check(table(rows, TURNS))
    assert found[(-7, 0)][1] == len({r[0] for r in rows} - {None})
    assert max(d for _, d in found) >= 41


def test_empty_and_clashing_columns(table):
    assert pt.conversation_trie(table([], TURNS)).collect() == []
    df = table([(1, 0, "a", "b c", "x", 5)], TURNS + ", node string, depth int")
    assert {(r.conv_id, r.depth) for r in pt.conversation_trie(df).collect()} in ({(1, 0)}, {(1, 0), (1, 1)})


def test_dense_names_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("id % 137 as a", "id % 3 as b")
    named = pt.dense_names(df, ["a", "b"]).collect()
    assert sorted(r.name for r in named) == list(range(len(named))) and len({(r.a, r.b) for r in named}) == len(named) == 411


def test_digest_of_ids_over_blocks(spark):
    ids = sorted({*range(0, 5000, 7), -3, -2000, 2**40})
    df = spark.createDataFrame([(0, 0, i) for i in ids] * 2 + [(5, 1, 5)], "conv_id long, depth long, member long").repartition(4)
    got = {r.conv_id: r.ends_sha256 for r in pt.member_digests(df).collect()}
    assert got == {0: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 5: hashlib.sha256(b"5").hexdigest()}


def test_crc_in_sql():
    got = duckdb.sql(f"select x, {pt.crc32_sql('x')} from (values (0), (-7), (123456789012)) t(x)").fetchall()
    assert all(c == zlib.crc32(str(x).encode()) for x, c in got)
