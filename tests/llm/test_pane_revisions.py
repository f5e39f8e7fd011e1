import math
import zlib
from datetime import datetime, timedelta

from corpusmill.llm import pane_revisions as pr
from tests.support import assert_same, duck

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
EPOCH = datetime(1970, 1, 1)


def brute(rows, n=10):
    """Batch by batch and row by row, straight from the definition."""
    once = {}
    for i, ts, arrived, _, kind, value, _ in rows:
        if ts is not None:
            once.setdefault(i, (ts, arrived, kind, value))
    batches = [[] for _ in range(n)]
    for i, (ts, arrived, kind, value) in once.items():
        day = (arrived or ts).toordinal() - EPOCH.toordinal()
        q = day % n
        ts -= timedelta(days=day - q)
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        h = zlib.crc32(str(i).encode()) if i is not None else 0
        batches[min(n - 1, q + max(0, h % 30 - 23))].append((i, (ts - EPOCH) // timedelta(microseconds=1), "none" if kind is None else kind, cents))
    now, panes, out = -math.inf, {}, []
    for b, batch in enumerate(batches):
        fresh = set()
        old = {k: (v["n"], v["cents"]) for k, v in panes.items()}
        for i, us, kind, cents in batch:
            pane = (us // pr.HOUR_US, kind)
            if now >= (pane[0] + 1) * pr.HOUR_US + pr.CLOSED_US:
                out.append((b, pane[0], i, 1, cents, "late", kind))
                continue
            state = panes.setdefault(pane, {"n": 0, "cents": 0, "emitted": False})
            state["n"] += 1
            state["cents"] += cents
            fresh.add(pane)
        for pane, s in list(panes.items()):
            row = (b, pane[0], -1, s["n"], s["cents"])
            if s["emitted"] and pane in fresh:
                out += [(b, pane[0], -1, *old[pane], "retract", pane[1]), (*row, "replace", pane[1])]
            elif not s["emitted"] and now >= (pane[0] + 1) * pr.HOUR_US + pr.DUE_US:
                s["emitted"] = True
                out.append((*row, "emit", pane[1]))
            elif not s["emitted"] and b == n - 1:
                out.append((*row, "final", pane[1]))
            if now >= (pane[0] + 1) * pr.HOUR_US + pr.CLOSED_US:
                del panes[pane]
        now = max([now, *(us for _, us, *_ in batch)])
    return sorted(out, key=repr)


def rows_of(got):
    columns = ["batch", "hour", "click_id", "n_rows", "cents", "record", "kind"]
    assert sorted(got.columns) == sorted(columns)
    return sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)


def test_given_clicks_equal_brute_force_and_sql(spark, small):
    df = spark.read.parquet(f"{small}/clicks.parquet")
    got = pr.click_panes(df)
    rows = rows_of(got)
    assert rows == brute([tuple(r) for r in df.collect()])
    assert {"late", "emit", "retract", "replace", "final"} == {r[5] for r in rows}
    assert_same(got, duck(small).sql(pr.click_panes_sql()))


def test_hot_pane_gaps_nulls_and_repeats(table):
    start = datetime(2024, 1, 2, 3)  # day 19724, batch 4 of 6: those before it have one row or none
    rows = [(i, start + timedelta(seconds=i % 600), start + timedelta(days=i % 3), 1, "view", 0.005 * i, "{}") for i in range(700)]
    rows += [rows[5], rows[5], (900, None, start, 1, "view", 1.0, None), (901, start - timedelta(days=9), start, 2, None, None, None)]
    rows += [(902, start, None, None, "none", float("nan"), None), (903, datetime(1960, 1, 1), start, None, "view", -0.005, None), (None, start, start, None, "view", 1.0, None)]
    rows += [(904, start + timedelta(days=3, hours=1), start + timedelta(days=3), 1, "", float("inf"), "x")]
    df = table(rows, CLICKS)
    got = rows_of(pr.click_panes(df, 6))
    assert got == brute(rows, 6)
    assert sum(r[3] for r in got if r[5] in ("late", "emit", "final")) >= 700


def test_empty_table_and_other_columns(table):
    assert rows_of(pr.click_panes(table([], CLICKS), 2)) == []
    row = (1, datetime(2024, 1, 1), datetime(2024, 1, 1), 1, "k", 1.5, None)
    df = table([(*row, 7, "x")], CLICKS + ", batch int, record string")
    assert rows_of(pr.click_panes(df, 2)) == brute([row], 2)
