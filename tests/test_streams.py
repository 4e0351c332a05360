"""State of ordered streams, driven by hand."""

import random
from types import SimpleNamespace

from pyspark.sql import Row

from litmill.streaming import jobs


class Handle:
    """State in dictionaries, with a count of calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _called(self, out=None):
        self.calls += 1
        return out


    def map(self, *_):
        held = {}
        return SimpleNamespace(
            updateValue=lambda k, v: self._called(held.__setitem__(k, v)), getValue=lambda k: self._called(held.get(k)),
            removeKey=lambda k: self._called(held.pop(k)), keys=lambda: self._called(iter(list(held))))

    def value(self, *_):
        held = []
        return SimpleNamespace(
            exists=lambda: self._called(bool(held)), get=lambda: self._called(held[0]), clear=lambda: self._called(held.clear()),
            update=lambda v: self._called(held.__setitem__(slice(None), [v])))

    getMapState, getValueState = map, value  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self._called(self.timers.add(at))

    def deleteTimer(self, at):  # noqa: N802
        self._called(self.timers.remove(at))


def driven(processor, lots, marks):
    """Rows that come out when lots arrive, each followed by a watermark, and the calls they took."""
    handle = Handle()
    processor.init(handle)
    out = []
    for lot, mark in zip(lots, marks):
        processor.handleInputRows(("k",), iter(lot), None)
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            out += processor.handleExpiredTimer(
                ("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m), SimpleNamespace(getExpiryTimeInMs=lambda a=at: a))
    return out, handle


def events(seed):
    rng = random.Random(seed)
    rows = [Row(at=1000 * rng.randrange(700 * 3_600_000), event_id=i, value=rng.choice("ab")) for i in range(3000)]
    late = [[r for r in rows if r.at < 1000 * 400 * 3_600_000 and r.event_id % 3], []]
    late[1] = [r for r in rows if r not in late[0]]
    for lot in late:
        rng.shuffle(lot)
    return sorted(rows), late


def test_changes_in_event_order_with_few_calls():
    rows, lots = events(1)
    rows.sort(key=lambda r: (r.at, r.event_id))
    marks = [min(r.at for r in lots[1]) // 1000, 800 * 3_600_000]
    out, handle = driven(jobs._Changes(3_600_000), lots, marks)
    want = [r for r, before in zip(rows, [None, *rows]) if before is None or r.value != before.value]
    assert [(r.at, r.event_id, r.stage) for r in out] == [(r.at, r.event_id, r.value) for r in want]
    assert handle.calls < 60 and not handle.timers


def test_lives_of_a_key_and_small_blocks(monkeypatch):
    monkeypatch.setattr(jobs.InOrder, "BLOCK", 16)
    monkeypatch.setattr(jobs.InOrder, "SORTED", 100)
    rows, lots = events(2)
    life = 36 * 3_600_000
    out, handle = driven(jobs._Lives(3_600_000, life), [*lots, [], []], [min(r.at for r in lots[1]) // 1000, 699 * 3_600_000, 800 * 3_600_000, 900 * 3_600_000])
    want, until = [], None
    for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
        if until is None or r.at >= until:
            want.append((r.at, r.event_id))
            until = r.at + 1000 * life
    assert [(r.at, r.event_id) for r in out] == want
    assert not handle.timers
