"""Boxes by classes against all pairs."""

from __future__ import annotations

import random

import pytest
from lorekeep.operators import boxes

SCHEMA = "id long, page string, x0 int, y0 int, x1 int, y1 int"


def brute(rows):
    pairs = []
    for a in rows:
        for b in rows:
            if None in (a[0], b[0], a[1]) or a[1] != b[1] or a[0] >= b[0]:
                continue
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if w > 0 and h > 0:
                area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
                iou = w * h / (area(a) + area(b) - w * h)
                if iou >= 0.5:
                    pairs.append((a[0], b[0], iou))
    return sorted(pairs)


def closure(pairs):
    label = {n: n for a, b, _ in pairs for n in (a, b)}
    moved = True
    while moved:
        moved = False
        for a, b, _ in pairs:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return sorted(label.items())


@pytest.mark.parametrize("chunk", [3, 512])
def test_pairs_and_components_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(boxes, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = []
    for _ in range(220):
        x, y = rng.randint(-20, 20), rng.randint(-20, 20)
        rows.append((rng.randint(0, 190), rng.choice("pqr"), x, y, x + rng.choice([-2, 0, 6, 7, 8]), y + rng.choice([0, 6, 8])))
    rows += [(500 + k, "s", 1, 1, 5, 5) for k in range(20)] + [(500, "s", 1, 1, 5, 5), (600, "s", 50, 50, 60, 60), (600, "s", 50, 50, 60, 60)]
    rows += [(None, "s", 1, 1, 5, 5), (700, None, 1, 1, 5, 5), (701, None, 1, 1, 5, 5), (800, "t", 3, 3, 3, 9), (801, "t", 3, 3, 3, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert sorted(map(tuple, boxes.iou_pairs(df, 0.5, 10).collect())) == want
    assert sorted(map(tuple, boxes.box_components(df, 0.5, 10).collect())) == closure(want)


def test_components_make_no_pairs_of_boxes_that_lie_alike(spark):
    """A hundred thousand boxes in two places: five thousand million pairs, which no one asked for."""
    n = 100_000
    df = spark.range(n).selectExpr("id", "'p' page", "cast(id % 2 as int) x0", "0 y0", "cast(12 + id % 2 as int) x1", "9 y1")
    got = boxes.box_components(df, 0.5, 10)
    assert got.groupBy("component").count().collect() == [(0, n)]


def test_members_of_a_large_class_are_dealt(spark):
    """No task's row holds a class whole, and every pair is there."""
    n = 3 * boxes.CHUNK + 100
    df = spark.range(n).selectExpr("id", "'p' page", "0 x0", "0 y0", "12 x1", "9 y1")
    assert boxes.iou_pairs(df, 0.5, 10).selectExpr("count(*)", "count(distinct a, b)", "count_if(a < b)").collect() == [(n * (n - 1) // 2,) * 3]
