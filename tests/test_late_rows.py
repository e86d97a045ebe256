import glob

import duckdb
import numpy as np

from catalog import streams
from scenelake.operators.motion import MotionSettings
from scenelake.streaming import stateful as st

SF = "/root/testdata/sf0.01"


def test_batches_of_several_files_count_the_same_late_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "FILE_ROWS", 2_000)
    monkeypatch.setattr(streams, "shared_folder", lambda _: str(tmp_path))
    run, text = streams.Q["stream_late_rows"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert run(spark, SF).first()["dropped"] == con.execute(text).fetchall()[0][0] > 0
    assert len(glob.glob(f"{tmp_path}/late/*/in/*.parquet")) > 3


def test_motion_takes_and_gives_arrays_and_goes_on_in_a_second_piece():
    n = 40
    draw = np.random.default_rng(3)
    step = np.sort(draw.choice(60, n, False)).astype(np.int64)
    rows = {"step": step, "t_us": (step + 1) * 100_000, "elapsed_us": np.full(n, 100_000), "vx": draw.normal(0, 90, n), "vy": np.zeros(n)}
    rows |= {"x1": draw.normal(0, 9, n), "y1": np.zeros(n), "x2": draw.normal(50, 9, n), "y2": np.full(n, 120.0)}
    complete = st._motion(MotionSettings())
    whole, memory = complete({}, rows), {}
    parts = [complete(memory, {c: x[at] for c, x in rows.items()}) for at in (slice(0, 17), slice(17, n))]
    for c in ("motion", "speed", "dwell_s", "age_s", "distance"):
        got = np.concatenate([p[c] for p in parts])
        assert (got == whole[c]).all() if c == "motion" else np.allclose(got, whole[c])
