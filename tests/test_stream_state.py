"""A call of the stream's processor takes many items, and reads and writes each item's state once."""

import pandas as pd

from sparkdecide.plans.qlearning import update
from sparkdecide.streaming.bandit import QState

SETTINGS = (6, 0.1, 0.95, 0.001)


class MapOf(dict):
    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value


class Handle:
    def getMapState(self, *_):  # noqa: N802
        self.table = MapOf()
        return self.table


def test_items_of_a_group_share_a_call_and_learn_apart():
    rows = [(item, e, t, (t + item) % 5, (t + item) % 5 + 1, float(t * item), (t + 2) % 5) for item in (3, 1, 2) for e in ("b", "a") for t in (2, 1, 3)]
    handle, state = Handle(), QState(*SETTINGS)
    state.init(handle)
    columns = ["item", "episode_id", "t", "x", "y", "reward", "x_next"]
    told = []
    for half in (rows, rows[::-1]):
        for out in state.handleInputRows((0,), iter([pd.DataFrame(half[:7], columns=columns), pd.DataFrame(half[7:], columns=columns)]), None):
            told += out.itertuples(index=False, name=None)
    assert handle.table.calls == 2 * 2 * 3
    want = {}
    for item in (1, 2, 3):
        q, n = {}, {}
        for _ in range(2):
            for r in sorted(r for r in rows if r[0] == item):
                update(q, n, *r[3:], *SETTINGS)
        want |= {(item, *k): (q[k], n[k]) for k in q}
    assert {r[:3]: r[3:] for r in told} == want
