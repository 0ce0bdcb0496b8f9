import random

import pytest

from tidemark.operators import align

CUES = (("a1", "a", "", 2.0, 30.0, 5.0), ("a2", "a", "", -4.5, 12.0, 7.0), ("a3", "a", "", 0.0, 50.0, 3.0), ("b1", "b", "", 1.0, 12.0, 1.0))


def cost(anchors, hits, o):
    total = 0.0
    for kind, t in anchors:
        total += min(w * min([cap, *[abs(h - (o + t + lag)) for c, h in hits if c == name]]) for name, k, _, lag, cap, w in CUES if k == kind)
    return total


def frames(spark, anchors, hits):
    a = spark.createDataFrame([(m, 1, i, k, t) for m, some in anchors.items() for i, (k, t) in enumerate(some)], "match string, period int, anchor int, kind string, t double")
    h = spark.createDataFrame([(m, c, t) for m, some in hits.items() for c, t in some], "match string, cue string, t double")
    return a, h, align.cue_table(spark, CUES)


@pytest.mark.parametrize("seed", [1, 2])
def test_second_differences_give_the_costs(spark, seed):
    r = random.Random(seed)
    anchors = {m: [(r.choice("ab"), round(r.uniform(0, 300), 2)) for _ in range(n)] for m, n in (("x", 9), ("y", 1), ("no hits", 3))}
    hits = {m: [(r.choice(CUES)[0], round(r.uniform(0, 400), r.choice([0, 2]))) for _ in range(n)] for m, n in (("x", 60), ("y", 12), ("no anchors", 5))}
    a, h, cues = frames(spark, anchors, hits)
    search = a.select("match", "period").distinct().selectExpr("match", "period", "40D center", "150D radius")
    got = {(x["match"], x["offset"]): x["cost"] for x in align.offset_costs(a, h, cues, search).collect()}
    assert len(got) == 3 * 301
    for (m, o), c in got.items():
        assert abs(c - cost(anchors[m], hits.get(m, []), o)) < 1e-6, (m, o)
    own = align.grid_costs(a, h, cues, search, ["match", "period", "anchor"], step=2.5).collect()
    assert len(own) == 13 * 121
    for x in own:
        assert abs(x["cost"] - cost([anchors[x["match"]][x["anchor"]]], hits.get(x["match"], []), x["offset"])) < 1e-6


def test_fit_and_leave_one_out_at_full_radii(spark):
    r = random.Random(7)
    times = sorted(r.uniform(0, 2700) for _ in range(25))
    anchors = {"x": [("a", t) for t in times], "one": [("b", 10.0)], "none": [("a", 5.0), ("b", 50.0)]}
    hits = {"x": [("a1", 725.0 + t + 2.0 + r.uniform(-1, 1)) for t in times] + [(r.choice(["a2", "b1"]), r.uniform(0, 6000)) for _ in range(150)], "one": [("b1", 500.0)]}
    a, h, cues = frames(spark, anchors, hits)
    search = a.select("match", "period").distinct().selectExpr("match", "period", "400D center", "1200D radius")
    fitted = align.fit_offset(a, h, cues, search)
    got = {x["match"]: x["offset"] for x in fitted.collect()}
    assert abs(got["x"] - 725.0) < 2 and abs(got["one"] - 489.0) < 0.01
    assert got["none"] == -801.0  # all alike: the first of the grid, and of the places around it
    loo = {(x["match"], x["anchor"]): x for x in align.loo_residuals(a, h, cues, fitted).collect()}
    assert len(loo) == 28 and loo["one", 0]["loo_offset"] == got["one"]
    for i in (0, 12, 24):
        rest = [x for j, x in enumerate(anchors["x"]) if j != i]
        grid = [got["x"] - 120 + k for k in range(241)]
        least = min(cost(rest, hits["x"], o) for o in grid)
        best = next(o for o in grid if cost(rest, hits["x"], o) <= least + 1e-6)
        fine = min((round(cost(rest, hits["x"], best - 1 + 0.25 * k), 9), best - 1 + 0.25 * k) for k in range(9))[1]
        assert abs(loo["x", i]["loo_offset"] - fine) < 1e-9


def test_no_row_an_offset_is_shuffled_for_a_fit(spark):
    a, h, cues = frames(spark, {"x": [("a", 10.0), ("b", 20.0)]}, {"x": [("a1", 30.0), ("b1", 40.0)]})
    search = a.select("match", "period").distinct().selectExpr("match", "period", "0D center", "1200D radius")
    found = align.offset_costs(a, h, cues, search)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.index("MapInArrow") < text.index("Exchange") and found.count() == 2401
    assert "BroadcastHashJoin [match" not in text
