import random

from scenelake.operators import linking as ln

SHAPE = """source_id string, label string, head_step long, head_det_id long, hits long, best double, first_t long, last_t long,
    first_box struct<x1:double,y1:double,x2:double,y2:double>, last_box struct<x1:double,y1:double,x2:double,y2:double>, vx double, vy double"""


def overlap(a, b):
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0.0


def best_down(rows, lost=1_500_000, least=0.2):
    pairs = []
    for t in (r for r in rows if r[4] >= 3 and r[5] >= 0.5):
        for h in rows:
            gap = h[6] - t[7]
            if t[:2] == h[:2] and 0 < gap <= lost and (w := overlap(t[9], h[8])) >= least:
                pairs.append((gap, -w, t[3], h[3], t[2], h[2], h[0]))
    used, links = set(), []
    for _, _, tail, head, tail_step, head_step, source in sorted(pairs):
        ends = {("t", source, tail_step, tail), ("h", source, head_step, head)}
        if not ends & used:
            used |= ends
            links.append((source, head_step, head, tail_step, tail))
    return sorted(links)


def test_a_tail_whose_best_head_is_taken_goes_on_with_its_next(spark):
    """Two persons are lost together and come back together; the second pair is no one's first choice."""
    b = lambda x: (x, 0.0, x + 50.0, 90.0)
    rows = [("s", "person", 0, i, 5, 0.9, 0, 400_000, b(x), b(x), 0.0, 0.0) for i, x in enumerate((100.0, 120.0))]
    rows += [("s", "person", 9, i, 1, 0.9, 900_000, 900_000, b(x), b(x), 0.0, 0.0) for i, x in enumerate((121.0, 130.0))]
    found = sorted(tuple(r) for r in ln._stitches(spark.createDataFrame(rows, SHAPE), ln.LinkSettings()).collect())
    assert found == [("s", 9, 0, 0, 1), ("s", 9, 1, 0, 0)] == best_down(rows)


def test_no_pair_stays_open_over_the_ends_of_slices(spark, monkeypatch):
    monkeypatch.setattr(ln, "BEATS_PER_SLICE", 2)
    draw, rows = random.Random(3), []
    for i in range(400):
        start, x = draw.randrange(0, 600), draw.uniform(0, 300)
        end, box = start + draw.randrange(0, 6), (x, 0.0, x + 50.0, 90.0)
        rows.append((draw.choice("ab"), draw.choice(["person", "laptop"]), start, i, draw.choice((1, 3, 4)), draw.choice((0.4, 0.9)), start * 100_000, end * 100_000, box, box, 0.0, 0.0))
    found = sorted(tuple(r) for r in ln._stitches(spark.createDataFrame(rows, SHAPE), ln.LinkSettings()).collect())
    assert found == best_down(rows) and len(found) > 50
