"""Chains, grids, rows and panels of a page's images."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from studylake.operators import layout as L
from studylake.plans import registry

ITEM = "doc long, page int, place int, kind string, id int, text string, x double, y double, width double, height double, pixels int, ink array<int>, ink_height int"


def items(spark, rows):
    """Rows of (kind, box or text[, ink])."""
    made = []
    for i, (kind, what, *ink) in enumerate(rows):
        box = what if isinstance(what, tuple) else (None,) * 4
        text, box = (what[4], what[:4]) if len(box) > 4 else (what if isinstance(what, str) else None, box)
        made.append((1, 1, i, kind, i, text, *map(lambda v: v and float(v) if v != 0 else 0.0, box), int(box[2] * 2) if box[2] else None, ink[0] if ink else None, 60 if ink else None))
    return spark.createDataFrame(made, ITEM)


def results(spark, rows, *columns):
    return [tuple(r) for r in L.image_results(items(spark, rows), "doc").orderBy("chain", "place").select(*(columns or ("form", "ids"))).collect()]


def image(x, y, w=80, h=60):
    return ("image", (x, y, w, h))


def test_images_without_a_box_stay_behind_the_others(spark):
    assert results(spark, [("image", None), image(10, 10), ("image", None), ("text", "x"), ("image", None)]) == [("one", [1]), ("one", [0]), ("one", [2]), ("one", [4])]
    assert results(spark, [("image", (5, 5, 0, 10))]) == [("one", [0])] and results(spark, []) == []


def test_grid_row_and_what_ends_a_chain(spark):
    square = [image(0, 0), image(100, 3), image(4, 100), image(96, 100)]
    assert results(spark, square, "form", "ids", "x0", "y0", "x1", "y1") == [("grid", [0, 1, 2, 3], 0.0, 0.0, 180.0, 160.0)]
    assert results(spark, [*square[:2], ("tag", "②"), *square[2:]]) == [("grid", [0, 1, 3, 4])]
    assert [r[0] for r in results(spark, [*square[:2], ("text", "words"), *square[2:]])] == ["one"] * 4
    assert [r[0] for r in results(spark, [*square[:3], image(120, 100)])] == ["one"] * 4  # out of its column
    assert [r[0] for r in results(spark, [*square[:2], image(0, 220), image(100, 220)])] == ["one"] * 4  # rows too far apart
    six = [image(90 * k, 10) for k in range(6)]
    assert results(spark, six) == [("row", [0, 1, 2, 3, 4, 5])]
    assert len(results(spark, six[:5])) == 5 and len(results(spark, [*six[:5], image(450, -15, h=110)])) == 6  # five; unlike heights
    assert [r for r in results(spark, [*six, image(0, 200)], "form", "new_line")] == [("row", False), ("one", True)]


def test_grid_of_a_row_of_like_heights_and_another(spark, tmp_path):
    """Two rows of seven, the upper one of unlike heights: one grid, as the SQL of layout_images groups it two."""
    lines = [(15, 16 * i + 21 - i, 1, i, (1.0, 50.0)[i % 2] if i <= 7 else 10.0, 1000.0, 0.0, 0.0) for i in range(1, 15)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["layout_images"](spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == sorted(con.execute(registry.ORACLE["layout_images"]).fetchall())
    assert [r[4:6] for r in got] == [("grid", 7)] * 2
    upper = [image(90 * k, 40 - h / 2, h=h) for k, h in enumerate((30, 80, 30, 80, 30, 80))]
    assert [(f, len(i)) for f, i in results(spark, [*upper, *[image(90 * k, 110) for k in range(6)]])] == [("grid", 12)]


def test_wide_image_in_columns_is_cut_as_in_the_sql(spark, tmp_path):
    """A low image of a document in columns, right above a line of letters: three panels."""
    lines = [(5532341, 165899, 59109, 2, 38.0, 56395.0, 0.07, 0.03), (5532341, 623421, 23106, 2, 1.0, 72556.05, 0.09, 0.05), (5532341, 1023998, 34865, 7, 34.0, 15729.48, 0.02, 0.08)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in registry.QUERIES["layout_images"](spark, str(tmp_path)).orderBy("chain", "place").collect()]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert got == con.execute(f"SELECT * FROM ({registry.ORACLE['layout_images']}) ORDER BY chain, place").fetchall()
    assert [r[4] for r in got] == ["panel"] * 3 + ["one"]


def test_canvas_is_bounded(spark):
    (canvas,) = results(spark, [image(0, 0), image(100, 0), image(0, 100), image(100, 100)], "canvas")[0]
    assert (canvas["width"], canvas["height"]) == (360, 320) and [tuple(p) for p in canvas["placed"]] == [(0, 0, 0, 160, 120), (1, 200, 0, 160, 120), (2, 0, 200, 160, 120), (3, 200, 200, 160, 120)]
    (wide,) = results(spark, [image(1000 * k, 0, 900, 90) for k in range(6)], "canvas")[0]
    assert wide["width"] == 3000 and max(p["x"] + p["width"] for p in wide["placed"]) <= 3001


def profile(cuts, width=240, bare=5):
    return [0 if any(abs(x - c) <= bare // 2 for c in cuts) else 30 for x in range(width)]


def test_panels_need_the_letters_below(spark):
    flat = ("image", (0, 0, 240, 60), profile((60, 120, 180)))
    letters = ("noise", (0, 70, 200, 10, "A B C D"))
    got = results(spark, [flat, letters], "form", "x0", "x1", "cut")
    assert [g[:3] for g in got] == [("panel", 60.0 * k, 60.0 * (k + 1)) for k in range(4)] and [tuple(g[3]) for g in got] == [(0, 60), (60, 120), (120, 180), (180, 240)]
    for below in (("noise", (0, 70, 200, 10, "A.")), ("noise", (0, 170, 200, 10, "A B C D")), ("text", "A B C D")):
        assert [r[0] for r in results(spark, [flat, below])] == ["one"]
    assert [r[0] for r in results(spark, [(*flat[:2], profile((30, 120))), letters])] == ["one"]  # uneven
    assert [r[0] for r in results(spark, [(*flat[:2], profile((120,))), letters])] == ["one"]  # two panels


def plain_cuts(ink, h):
    w, found = len(ink), set()
    if w < 200 or h < 20 or w / h < 2.2:
        return None
    for hit, least in ((lambda v: v <= h * 0.02, 3), (lambda v: v >= h * 0.7, 2)):
        start = None
        for x in range(w + 1):
            if x < w and hit(ink[x]):
                start = x if start is None else start
            elif start is not None:
                if x - start >= least:
                    found.add((start + x - 1) // 2)
                start = None
    inner = sorted(c for c in found if max(w // 20, 2) < c < w - max(w // 20, 2))
    n = len(inner) + 1
    if not 3 <= n <= 5:
        return None
    nearest = [min(inner, key=lambda c: (abs(c - w / n * k), c)) for k in range(1, n)]
    if len(set(nearest)) < n - 1 or any(abs(c - w / n * k) > w / n * 0.4 for k, c in enumerate(nearest, 1)):
        return None
    sides = [b - a for a, b in zip([0, *nearest], [*nearest, w])]
    return nearest if max(sides) <= 1.6 * max(min(sides), 1) else None


def test_cuts_equal_a_plain_loop(spark):
    pick = random.Random(3)
    rows = []
    for _ in range(400):
        w, h, n = pick.randrange(150, 420), pick.choice((15, 40, 60, 90)), pick.randrange(1, 7)
        ink = [h // 2] * w
        for k in range(1, n):
            c, wide = int(w * k / n + pick.gauss(0, w / 60)), pick.randrange(1, 6)
            for x in range(max(c, 0), min(c + wide, w)):
                ink[x] = pick.choice((0, 0, 0, h, 1)) if pick.random() < 0.1 else (0 if k % 2 else h)
        rows.append((ink, h))
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ink array<int>, h int").select("i", L.column_cuts(F.col("ink"), F.col("h")).alias("c")).orderBy("i").select("c").collect()]
    want = [plain_cuts(*r) for r in rows]
    assert got == want and 20 < sum(w is not None for w in want) < 380


def test_one_shuffle(spark):
    plan = L.image_results(items(spark, [image(0, 0), image(100, 0)]), "doc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
