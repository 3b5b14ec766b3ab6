"""A batch's lines of a visit read and write its state once."""

from collections import Counter

from pyspark.sql import Row

from millrace.streaming import visits


class Store:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] += 1
            if name == "update":
                self.value = args[0]
            return self.value if name == "get" else None

        return call

    getValueState = lambda self, *_: self
    getMapState = lambda self, *_: self


def test_state_is_read_and_written_once():
    calls = Counter()
    store, phases = Store(calls), visits.Phases(1000)
    phases.init(store)
    for first in (100, 0):  # a later batch with earlier lines
        list(phases.handleInputRows((1,), iter([Row(phase=f"p{k % 3}", ms=first + k) for k in range(300)]), None))
    assert calls["get"] == 2 and calls["update"] == 2 and calls["registerTimer"] == 1 and calls["deleteTimer"] == 0
    assert [(r.phase, r.ms) for r in phases.handleExpiredTimer((1,), None, None)] == [("p0", 397), ("p1", 398), ("p2", 399)]
