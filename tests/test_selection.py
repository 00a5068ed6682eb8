"""Balanced selection: few rounds whatever the size, and what a plain loop picks."""

from scriptorium.operators import selection
from scriptorium.plans import sampling as P

BOX = "struct<x:int,y:int,width:int,height:int>"


def crowd(spark):
    """Papers of 90 candidates with one score each, so that a short window holds one paper only; half are copies."""
    rows = []
    for paper in range(12):
        for i in range(90):
            category = P.EXPANSION_CATEGORIES[i % 5]
            x, y = 13 * (i // 10), 60 * (i % 3)
            rows.append((1, f"paper-{paper:02d}", i % 2, 100 * paper + i, category, (x, y, 40, 40), 0.9))
    schema = f"dataset_id int, paper_alias string, page_number int, proposal_no long, category string, region {BOX}, score double"
    return rows, spark.createDataFrame(rows, schema)


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    common = max(0, w) * max(0, h)
    return common / (a[2] * a[3] + b[2] * b[3] - common)


def by_loop(rows, quotas):
    picked = []
    for category, quota in quotas.items():
        for r in sorted((r for r in rows if r[4] == category), key=lambda r: (-r[6], r[1], r[2], r[5][1], r[5][0], r[3])):
            mine = [k for k in picked if k[1] == r[1]]
            if sum(k[4] == category for k in picked) < quota and len(mine) < 5 and all(k[2] != r[2] or iou(k[5], r[5]) <= 0.55 for k in mine):
                picked.append(r)
    return [(r[3], n + 1) for n, r in enumerate(picked)]


def test_rounds_do_not_follow_the_papers(spark, monkeypatch):
    rows, df = crowd(spark)
    quotas = dict.fromkeys(P.EXPANSION_CATEGORIES, 9)
    expected = by_loop(rows, quotas)
    cuts = []
    cut, original = selection.cut_lineage, P.select_balanced
    monkeypatch.setattr(selection, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    for window, most in ((None, 2), (8, 5)):
        if window:
            monkeypatch.setattr(P, "select_balanced", lambda *a, **k: original(*a, **{**k, "window": window}))
        cuts.clear()
        got = sorted(((r.proposal_no, r.pick_no) for r in P.select_expansion(df, quotas).collect()), key=lambda r: r[1])
        assert got == expected
        assert len(cuts) <= most
