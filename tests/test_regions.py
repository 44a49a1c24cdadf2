from itertools import permutations

import numpy as np
import pytest

from stratafolio.operators import regions


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 6, 2)
    w = rng.random((a, b)) * (rng.random((a, b)) < 0.7)
    got = regions.best_assignment(w)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got}) == min(a, b)
    tall = w if a >= b else w.T
    best = max(sum(tall[p[j], j] for j in range(tall.shape[1])) for p in permutations(range(tall.shape[0]), tall.shape[1]))
    assert sum(w[i, j] for i, j in got) == pytest.approx(best)


def test_pairs(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 1.0, 1.0), (1, 1, 2, 0.0, 0.0, 1.0, 0.6), (1, 2, 5, 0.0, 0.0, 1.0, 0.9), (1, 2, 6, 0.0, 0.0, 1.0, 0.55), (2, 1, 7, 0.0, 0.0, 0.1, 0.1)]
    frame = spark.createDataFrame(rows, "page long, reading int, region_id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.first, r.second) for r in regions.paired(frame, "page").collect()}
    assert got == {(1, 1, 5), (1, 2, 6), (2, 7, None)}
    assert regions.greedy(np.array([[0.6, 0.9], [0.9, 0.1]]), 0.5) == [(0, 0)]


def region(kind, x0, y0, x1, y1):
    return dict(kind=kind, x0=x0, y0=y0, x1=x1, y1=y1)


CHART, SHIFTED, FAR, TABLE, PROSE = region("chart", 0, 0, 0.4, 0.4), region("chart", 0.05, 0, 0.45, 0.4), region("chart", 0.6, 0.6, 1, 1), region("table", 0, 0, 0.4, 0.4), region("narrative", 0.5, 0, 1, 0.4)


@pytest.mark.parametrize(
    "one, two, want",
    [
        ([], [], ([], True, 0)),
        ([CHART], [SHIFTED], ([], True, 1)),
        ([CHART], [FAR], (["chart_location_difference"], False, 0)),
        ([CHART], [], (["chart_count_difference", "region_count_difference"], False, 0)),
        ([CHART], [TABLE], (["chart_count_difference", "chart_table_conflict", "region_category_difference"], False, 0)),
        ([CHART], [CHART, PROSE], (["chart_consistent_other_region_difference", "region_count_difference"], True, 1)),
        ([TABLE], [TABLE], (["no_chart_table_or_body_only"], True, 0)),
        ([PROSE], [region("narrative", 0, 0.5, 0.4, 1)], (["chart_consistent_other_region_difference", "no_chart_table_or_body_only", "region_location_difference"], True, 0)),
        ([CHART, TABLE], [TABLE, CHART], (["chart_table_conflict"], True, 1)),
        ([FAR, CHART], [SHIFTED, FAR], ([], True, 2)),
    ],
)
def test_what_two_readings_differ_in(one, two, want):
    assert regions.differences(one, two) == want


def test_pages_are_compared(spark):
    rows = [(1, 1, 0, *CHART.values()), (1, 2, 0, *SHIFTED.values()), (2, 1, 0, *CHART.values()), (3, 2, 5, *TABLE.values())]
    frame = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], "page long, reading int, region_id int, kind string, x0 double, y0 double, x1 double, y1 double")
    got = {r.page: (r.reasons, r.charts_agree, r.chart_pairs) for r in regions.compared(frame, "page").collect()}
    assert got == {1: ([], True, 1), 2: (["chart_count_difference", "region_count_difference"], False, 0), 3: (["chart_consistent_other_region_difference", "region_count_difference"], True, 0)}


def test_dispositions_and_the_review_queue(spark):
    from stratafolio.operators import governance

    files = spark.createDataFrame([(n, "h") for n in ("edited", "noted", "current", "linked", "start.md", "sent", "stray", "old", "other")], "name string, sha256 string")
    manifest = spark.createDataFrame([("edited", "reading-publisher", "x"), ("noted", "reading-publisher", "h"), ("old", "reading-publisher", "h"), ("other", "someone", "h"), ("old", "reading-publisher", "h")], "name string, owner string, last_hash string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r.name: r.disposition for r in governance.file_dispositions(files, manifest, names("current", "edited"), names("linked", "linked"), names("noted"), names("sent"), ("start.md",)).collect()}
    assert got == {"edited": "conflict-human-edit", "noted": "keep", "current": "keep", "linked": "keep", "start.md": "keep", "sent": "keep", "stray": "unknown-owner", "old": "archive-candidate", "other": "keep"}
    risk = "Figure 2 Axis\n" + "\n".join(map(str, range(30)))
    blocks = spark.createDataFrame([("b1", 1, risk), ("b2", 2, "text"), ("b3", 3, "List of figures\n" + risk)], "block_id string, seq int, text string")
    first = governance.review_queue(blocks, blocks.limit(0), 2)
    assert {r.block_id: r.status for r in first.collect()} == {"b1": "pending", "b2": "not_flagged"}
    assert {r.block_id: (r.kind, r.status) for r in governance.review_queue(blocks, first, 2).collect()} == {"b3": ("navigation", "not_flagged")}


def test_many_pages_at_once_are_as_each_alone():
    rng = np.random.default_rng(3)
    w = np.round(rng.random((200, 5, 5)) * 4) * (rng.random((200, 5, 5)) < 0.7)
    rows = regions.best_assignments(w)
    for page in range(200):
        assert [(i, j) for j, i in enumerate(rows[page])] == regions.best_assignment(w[page])
        best = max(sum(w[page, p[j], j] for j in range(5)) for p in permutations(range(5)))
        assert w[page][rows[page], np.arange(5)].sum() == pytest.approx(best)


def test_pages_of_many_sizes_are_as_each_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(page, reading, k, str(rng.choice(["chart", "table", "narrative", "odd"])), *map(float, (x, y, x + 0.4, y + 0.4))) for page in range(60) for reading in (1, 2) for k in range(rng.integers(0, 6)) for x, y in [rng.integers(0, 3, 2) * 0.15]]
    frame = spark.createDataFrame(rows, "page long, reading int, region_id long, kind string, x0 double, y0 double, x1 double, y1 double")
    got = {r.page: (r.reasons, r.charts_agree, r.chart_pairs) for r in regions.compared(frame, "page").collect()}
    sides = {page: [[region(*r[3:]) for r in rows if r[:2] == (page, k)] for k in (1, 2)] for page in {r[0] for r in rows}}
    assert got == {page: regions.differences(*both) for page, both in sides.items()}
    pairs = {}
    for r in regions.paired(frame, "page").collect():
        pairs.setdefault(r.page, []).append((r.first, r.second))
    for page, (one, two) in sides.items():
        assert sorted(i for i, _ in pairs[page] if i is not None) == list(range(len(one))) and sorted(j for _, j in pairs[page] if j is not None) == list(range(len(two)))


def test_readings_are_shuffled_once(spark, sf):
    from stratafolio.plans import QUERIES

    for name in ("jn21_greedy_pairs", "jn22_optimal_pairs", "jn22_region_reasons"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name
