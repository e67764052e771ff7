import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from voxframe.plans import catalog
from voxframe.streaming import amend


class Held:
    """State in memory, as the engine's."""

    def __init__(self):
        self.rows, self.value = {}, None

    def getMapState(self, *_):  # noqa: N802
        return Held()

    getValueState = getMapState  # noqa: N815
    containsKey = lambda self, k: k in self.rows  # noqa: E731, N815
    getValue = lambda self, k: self.rows[k]  # noqa: E731, N815
    iterator = lambda self: iter(self.rows.items())
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def updateValue(self, k, v):  # noqa: N802
        self.rows[k] = v

    def update(self, v):
        self.value = v

    def clear(self):
        self.rows, self.value = {}, None


def plain(events):
    """file_id 1 after all events, item by item."""
    last = lambda kind, k, c: max((e for e in events if e["kind"] == kind and e[c] == k), key=lambda e: e["event_id"], default=None)
    out = {}
    for i in {e["idx"] for e in events if e["kind"] == "segment"}:
        s, l = last("segment", i, "idx"), last("labelled", i, "idx")
        label = (l or s)["local_label"]
        w = last("resolved", label, "local_label") if label is not None else None
        out[i] = (s["text"], label, w and w["global_id"], max(e["event_id"] for e in (s, l, w) if e))
    return out


def made(rng):
    events, n = [], 0
    for _ in range(rng.randint(1, 25)):
        n += rng.randint(1, 3)
        kind = rng.choice(["segment", "segment", "labelled", "resolved"])
        label = rng.choice([None, "a", "b", "c"]) if kind != "resolved" else rng.choice("abc")
        events.append({"file_id": 1, "event_id": n, "kind": kind, "idx": None if kind == "resolved" else rng.randint(0, 4), "text": f"t{n}" if kind == "segment" else None, "seg_start": 0.5, "seg_end": 1.5, "local_label": label, "global_id": rng.choice([None, n]) if kind == "resolved" else None, "similarity": 0.5})
    return events, {**events[0], "event_id": n + 1, "kind": "finished", "idx": len(events)}


@pytest.mark.parametrize("seed", range(40))
def test_any_order_gives_the_batch_answer(seed):
    rng = random.Random(seed)
    events, end = made(rng)
    want = plain(events)
    log = [*events, end]
    rng.shuffle(log)
    a = amend.Amender()
    a.init(Held())
    table, at = {}, 0
    while at < len(log):
        step = rng.randint(1, 6)
        for out in a.handleInputRows((1,), iter([pd.DataFrame(log[at : at + step])]), None):
            for r in out.astype(object).itertuples(index=False):
                now = (r.text, r.local_label, None if pd.isna(r.global_id) else r.global_id, r.revision, None if pd.isna(r.similarity) else r.similarity)
                assert table.get(r.idx) != now  # only what changes is emitted
                table[r.idx] = now
        at += step
    assert {i: row[:-1] for i, row in table.items()} == want
    assert not (a.said.rows or a.who.rows or a.seen.value)


def test_stream_with_a_restart(spark, sf, tmp_path):
    events = catalog._event_log(spark, sf).where("file_id < 4").cache()
    want = sorted(map(tuple, amend.after_all(events).collect()), key=repr)
    at, schema = f"file://{tmp_path}", events.select(*amend.COLUMNS).schema
    log = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/log")
    for k, part in enumerate(("event_id % 3 = 0", "event_id % 3 = 1 and idx > 2", "event_id % 3 = 2 or (event_id % 3 = 1 and coalesce(idx, 0) <= 2)")):
        events.where(part).select(*amend.COLUMNS).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(f"{at}/log")
        amend.follow(log(), at)  # goes on where the former one ended
        assert len(list((tmp_path / "rows").glob("batch=*"))) == k + 1
    amend.follow(log(), at)
    got = amend.transcript(spark, at)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 10
    assert got.select("file_id", "idx").distinct().count() == len(want)
