"""What a key of a keyed stream holds before the watermark."""

import numpy as np
import pandas as pd

from scenelake.streaming import stateful as st


class Caught:
    """Stands for a stream and catches the function given to Spark."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def applyInPandasWithState(self, run, *a):
        self.run = run
        return self


class State:
    hasTimedOut, exists, mark = False, False, 0

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False

    def setTimeoutTimestamp(self, t): ...


def test_a_large_key_waits_packed_and_comes_out_in_order_piece_by_piece(spark):
    sizes, n = [], 200_000

    def complete(memory, rows):
        sizes.append(len(rows))
        return rows

    stream = st.in_order(Caught(), ["source_id"], "source_id string, t_us long, step long, zone string", complete, order=("t_us", "zone"))
    step = np.random.default_rng(1).permutation(n)
    rows = pd.DataFrame({"source_id": "cam", "step": step, "t_us": step // 2 * 1000, "_ms": step // 2, "zone": [f"{x:020d}" for x in step]})
    state = State()
    assert not list(stream.run(("cam",), (rows[a : a + 10_000] for a in range(0, n, 10_000)), state)) or sizes == [2]
    assert len(state.get[0]) < 30 * n
    early = sum(sizes)
    for state.mark in (30_000, 1_000_000):
        state.hasTimedOut = True
        out = pd.concat(list(stream.run(("cam",), iter(()), state)))
        assert out["step"].tolist() == list(range(early, early + len(out))) and (out["source_id"] == "cam").all()
        early += len(out)
    assert early == n and max(sizes) < n // 4 and not state.exists
