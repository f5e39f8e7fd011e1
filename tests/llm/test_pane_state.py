from datetime import datetime, timedelta
from pathlib import Path

from corpusmill.llm import pane_revisions as pr
from tests.llm.test_pane_revisions import CLICKS, brute, rows_of


def test_one_light_state_store_for_a_partition_and_exact_late_ids(table, monkeypatch):
    folders, run = set(), pr._run_batch
    monkeypatch.setattr(pr, "_run_batch", lambda session, folder, *rest: (folders.add(folder), run(session, folder, *rest)))
    start = datetime(2024, 1, 2)  # day 19724, batch 0 of 4
    rows = [(i, start + timedelta(days=i % 2), start + timedelta(days=i % 2), 1, "a", 0.25 * i, None) for i in range(40)]
    late = [(i, start - timedelta(days=5), start + timedelta(days=3), 1, "a", 1.0, None) for i in (None, 2**60 + 1, 2**60 + 4)]
    df = table(rows + late, CLICKS)
    got = rows_of(pr.click_panes(df, 4))
    assert got == brute(rows + late, 4)
    assert {r[2] for r in got if r[5] == "late"} == {r[0] for r in late}
    state = Path(folders.pop().removeprefix("file:")) / "checkpoint/state"
    assert [f.name for f in state.iterdir() if f.name.isdigit()] == ["0"]  # shards keep none
    assert not [f for f in state.rglob("*") if f.suffix in (".zip", ".sst")]  # no RocksDB, whose native memory stays with the executor
