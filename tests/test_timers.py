from lumenrec.streaming import events as E


class Handle:
    """Counts what a key's state and timers are asked for."""

    def __init__(self):
        self.calls, self.timers, self.rows = 0, set(), None

    def getListState(self, *_):
        return self

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, None

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.discard(t)


class Time:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    def getCurrentWatermarkInMs(self):
        return 10_000_000_000


def test_many_sessions_of_a_key_cost_few_calls():
    handle, gap = Handle(), 1_000
    processor = E._Sessions(gap)
    processor.init(handle)
    row = type("R", (), {})
    rows = []
    for i in range(500):
        r = row()
        r.ms = i * 5_000
        rows.append(r)
    list(processor.handleInputRows((1,), iter(rows), None))
    out = []
    while handle.timers:
        at = min(handle.timers)
        handle.timers.discard(at)
        out += list(processor.handleExpiredTimer((1,), Time(10_000_000_000), Time(at)))
    assert len(out) == 500 and handle.calls < 10
