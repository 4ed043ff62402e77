"""What an event costs the response state: calls between Python and the state store."""

from types import SimpleNamespace

from pyspark.sql import Row

from lectern.streaming import jobs


class Store:
    """A handle and its one value, which count their calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_an_event_reads_and_writes_once_and_a_timer_moves_when_it_fires():
    store, state, day = Store(), jobs.LastValue(10), 1_000_000
    state.init(store)
    put = lambda at, n, value: [tuple(r) for r in state.handleInputRows((1, "a"), iter([Row(at=at, event_id=n, value=value)]), None)]
    fire = lambda at: list(state.handleExpiredTimer((1, "a"), None, SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert put(5 * day, 1, 1.0) == [(1, "a", 5 * day, 1, 1.0)] and store.calls == 3 and store.timers == [15_000]
    assert put(9 * day, 2, None) == [(1, "a", 9 * day, 2, None)] and store.calls == 5
    assert put(8 * day, 3, 4.0) == [] and store.calls == 6
    fire(15_000)
    assert store.timers[-1] == 19_000 and store.value == (9 * day, 2, None)
    fire(19_000)
    assert store.value is None
