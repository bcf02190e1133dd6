"""Queries over page layouts: boxes and column profiles of varied geometry from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from studylake.operators import layout as L
from studylake.sources import bindings as B

from .base import query

#: Profiles k(id, w, p, j, g, seed) of 60 pixels' height: p panels, gaps of 2g + 1 columns moved by up to j / 2, frames by the seed; their cuts.
_CUTS = """places AS (SELECT id, w, seed, g, i * w // p + (seed * i * 7) % j - j // 2 AS place FROM k, unnest(range(1, p)) t(i)),
gaps AS (SELECT k.id, k.w, k.seed, x, bool_or(abs(x - place) <= k.g) AS gap FROM k CROSS JOIN unnest(range(0, w)) t(x) LEFT JOIN places USING (id) GROUP BY ALL),
ink AS (SELECT id, w, x, CASE WHEN NOT coalesce(gap, false) THEN 30 WHEN seed % 3 = 0 THEN 60 WHEN seed % 2 = 0 THEN 1 ELSE 2 END AS ink FROM gaps),
hit AS (SELECT id, w, x, 'bare' AS kind FROM ink WHERE ink <= 60 * 0.02 UNION ALL SELECT id, w, x, 'frame' FROM ink WHERE ink >= 60 * 0.7),
isle AS (SELECT *, x - row_number() OVER (PARTITION BY id, kind ORDER BY x) AS isle FROM hit),
mid AS (SELECT DISTINCT id, w, (min(x) + max(x)) // 2 AS c FROM isle GROUP BY id, w, kind, isle HAVING count(*) >= CASE kind WHEN 'bare' THEN 3 ELSE 2 END),
inner_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c) AS nth, count(*) OVER (PARTITION BY id) + 1 AS panels, lag(c, 1, 0) OVER (PARTITION BY id ORDER BY c) AS before, lead(c, 1, w) OVER (PARTITION BY id ORDER BY c) AS after FROM mid WHERE c > greatest(w // 20, 2) AND c < w - greatest(w // 20, 2)),
cuts AS (SELECT id, list(CAST(c AS INT) ORDER BY c) AS cuts FROM inner_ WHERE panels BETWEEN 3 AND 5 AND w / 60 >= 2.2 AND w >= 200 GROUP BY id, w, panels
  HAVING bool_and(abs(c - w / panels * nth) <= w / panels * 0.4) AND greatest(max(c - before), max(after - c)) <= 1.6 * greatest(least(min(c - before), min(after - c)), 1))"""


def _ink(w, p, j, g, seed):
    places = F.transform(F.sequence(F.lit(1), p - 1), lambda i: F.floor(i * w / p).cast("int") + ((seed * i * 7) % j).cast("int") - F.floor(j / 2).cast("int"))
    dark = F.when(seed % 3 == 0, 60).when(seed % 2 == 0, 1).otherwise(2)
    return L.bound(places, lambda all_: F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.when(F.exists(all_, lambda c: F.abs(x - c) <= g), dark).otherwise(30)))


@query(f"""WITH k AS (SELECT p_partkey AS id, CAST(120 + (p_partkey * 13) % 300 AS INT) AS w, 2 + p_partkey % 5 AS p, 1 + p_size AS j, p_partkey // 5 % 4 AS g, p_partkey AS seed FROM part), {_CUTS}
SELECT id, w, cuts FROM k LEFT JOIN cuts USING (id)""")
def panel_cuts(spark, sf_dir):
    """Cuts of wide images with two to six panels, between bare columns or frames, some uneven."""
    n = F.col("p_partkey").cast("int")
    rows = B.dealt(B.table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), (120 + (n * 13) % 300).alias("w"), (2 + n % 5).alias("p"), (1 + F.col("p_size")).cast("int").alias("j"), (F.floor(n / 5) % 4).cast("int").alias("g"))
    ink = _ink(F.col("w"), F.col("p"), F.col("j"), F.col("g"), F.col("id"))
    return rows.select("id", "w", L.column_cuts(ink, F.lit(60)).alias("cuts"))


#: Items of pages: an order's lines in columns by its number, moved a little, with tags, noise and texts between; flat images in one column.
_ITEMS = """v AS (SELECT l_orderkey AS doc, CAST(l_orderkey % 3 AS INT) AS page, l_linenumber AS id, l_partkey AS part, l_suppkey AS supp, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t, CAST(floor(l_quantity) AS INT) AS q, l_orderkey % 6 = 4 AS flat, ([2, 3, 6, 7, 1, 2])[l_orderkey % 6 + 1] AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem),
b AS (SELECT *, CASE WHEN flat AND (part + place) % 3 = 1 THEN 'noise' WHEN flat THEN 'image' WHEN (part + place) % 16 = 0 THEN 'tag' WHEN (part + place) % 16 = 1 THEN 'noise' WHEN (part + place) % 16 = 2 THEN 'text' ELSE 'image' END AS kind,
  CASE WHEN part % 4 = 0 THEN 'A.' ELSE 'A B. C D' END AS text, 30.0 + q AS height, CASE WHEN flat THEN 150.0 + q * 5 ELSE 60.0 + d END AS width,
  CASE WHEN supp % 17 <> 0 THEN 50.0 + (place - 1) % c * 80 + d + t END AS x, 100.0 + (place - 1) // c * CASE WHEN flat THEN 90 ELSE 100 + doc % 5 * 30 END + part % 12 - (30.0 + q) / 2 AS y FROM v)"""


@query(f"""WITH {_ITEMS}, o AS (SELECT *, count(*) FILTER (WHERE kind IN ('text', 'noise')) OVER own AS chain, lead(kind) OVER own AS next_kind, lead(text) OVER own AS next_text, lead(y) OVER own - y - height AS below FROM b WINDOW own AS (PARTITION BY doc, page ORDER BY place)),
i AS (SELECT *, x IS NOT NULL AS boxed, CASE WHEN x IS NOT NULL THEN y + height / 2 END AS cy, coalesce(x IS NOT NULL AND width / height >= 2.2 AND height <= 300 AND next_kind = 'noise' AND below BETWEEN 0 AND 80 AND next_text = 'A B. C D', false) AS wide FROM o WHERE kind = 'image'),
f AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY doc, page, chain, boxed ORDER BY cy) > 25 THEN 1 ELSE 0 END AS far FROM i), r AS (SELECT *, sum(far) OVER (PARTITION BY doc, page, chain, boxed ORDER BY cy) AS r FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, page, chain, boxed, r ORDER BY x, place) AS col, count(*) OVER (PARTITION BY doc, page, chain, boxed, r) AS n, avg(cy) OVER (PARTITION BY doc, page, chain, boxed, r) AS mean, max(height) OVER (PARTITION BY doc, page, chain, boxed, r) / min(height) OVER (PARTITION BY doc, page, chain, boxed, r) <= 1.8 AS alike FROM r),
s AS (SELECT DISTINCT doc, page, chain, r, n, mean FROM n WHERE boxed), m AS (SELECT doc, page, chain, count(*) AS rows, min(n) AS least, max(n) AS most, max(step) AS step FROM (SELECT *, mean - lag(mean) OVER (PARTITION BY doc, page, chain ORDER BY r) AS step FROM s) GROUP BY ALL),
a AS (SELECT n.doc, n.page, n.chain, max(abs(n.x - h.x)) AS off FROM n JOIN n h ON h.doc = n.doc AND h.page = n.page AND h.chain = n.chain AND h.col = n.col AND h.r = 0 AND h.boxed WHERE n.boxed GROUP BY ALL),
u AS (SELECT n.*, boxed AND coalesce(rows IN (2, 3) AND least = most AND least >= 2 AND step <= 200 AND off <= 12, false) AS grid, boxed AND n.n BETWEEN 6 AND 9 AND alike AS band FROM n LEFT JOIN m USING (doc, page, chain) LEFT JOIN a USING (doc, page, chain)),
k AS (SELECT doc * 100 + place AS id, CAST(200 + part % 150 AS INT) AS w, 2 + doc % 5 AS p, 1 + q AS j, place % 3 AS g, part AS seed FROM u WHERE wide AND n = 1 AND NOT grid), {_CUTS},
e AS (SELECT doc, page, chain, boxed, CASE WHEN NOT grid THEN r END AS ur, CASE WHEN NOT grid AND NOT band THEN col END AS uc, grid, band, count(*) AS images, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1, arg_min(cy, r * 100 + col) AS cy, min(r * 100 + col) AS rc, min(place) AS place, min(doc * 100 + place) AS id FROM u GROUP BY ALL),
z AS (SELECT e.*, cuts, w, unnest(range(0, coalesce(len(cuts), 0) + 1)) AS part FROM e LEFT JOIN cuts ON cuts.id = e.id AND images = 1 LEFT JOIN k ON k.id = e.id)
SELECT doc, page, chain, CAST(row_number() OVER own AS INT) AS place, CASE WHEN cuts IS NOT NULL THEN 'panel' WHEN grid THEN 'grid' WHEN band THEN 'row' ELSE 'one' END AS form, CAST(images AS INT) AS images,
  round(CASE WHEN cuts IS NULL THEN x0 ELSE x0 + part * ((x1 - x0) / (len(cuts) + 1)) END, 3)::DOUBLE AS x0, y0::DOUBLE AS y0, round(CASE WHEN cuts IS NULL THEN x1 ELSE x0 + (part + 1) * ((x1 - x0) / (len(cuts) + 1)) END, 3)::DOUBLE AS x1, y1::DOUBLE AS y1,
  coalesce(abs(cy - lag(cy) OVER own) > 25, false) AS new_line, CASE WHEN grid OR band THEN CAST(floor((x1 - x0) * 2 + 0.5) AS INT) END AS canvas_width,
  CASE WHEN cuts IS NOT NULL THEN CASE WHEN part = 0 THEN 0 ELSE cuts[part] END END AS cut_start FROM z WINDOW own AS (PARTITION BY doc, page, chain ORDER BY boxed DESC, rc, place, part)""")
def layout_images(spark, sf_dir):
    """What the images of each page's layout become: grids, rows, single images, panels."""
    line = B.table(spark, sf_dir, "lineitem")
    doc, part = F.col("l_orderkey"), F.col("l_partkey")
    order = L.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = line.select(doc.alias("doc"), (doc % 3).cast("int").alias("page"), part.alias("part"), F.col("l_suppkey").alias("supp"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("t"),
                       F.floor("l_quantity").cast("int").alias("q"), (doc % 6 == 4).alias("flat"), F.element_at(F.array(*[F.lit(c) for c in (2, 3, 6, 7, 1, 2)]), (doc % 6 + 1).cast("int")).alias("c"), F.row_number().over(order).alias("place"))
    at, turn = F.col("place") - 1, (F.col("part") + F.col("place")) % 16
    kind = F.when(F.col("flat"), F.when((F.col("part") + F.col("place")) % 3 == 1, "noise").otherwise("image")).when(turn == 0, "tag").when(turn == 1, "noise").when(turn == 2, "text").otherwise("image")
    pitch = F.when(F.col("flat"), 90).otherwise(100 + F.col("doc") % 5 * 30)
    rows = rows.withColumn("kind", kind).withColumn("text", F.when(F.col("part") % 4 == 0, "A.").otherwise("A B. C D")).withColumn("height", 30.0 + F.col("q"))
    rows = rows.withColumn("width", F.when(F.col("flat"), 150.0 + F.col("q") * 5).otherwise(60.0 + F.col("d"))).withColumn("x", F.when(F.col("supp") % 17 != 0, 50.0 + at % F.col("c") * 80 + F.col("d") + F.col("t")))
    rows = rows.withColumn("y", 100.0 + F.floor(at / F.col("c")) * pitch + F.col("part") % 12 - F.col("height") / 2)
    ink = _ink((200 + F.col("part") % 150).cast("int"), (2 + F.col("doc") % 5).cast("int"), 1 + F.col("q"), F.col("place") % 3, F.col("part"))
    flat_image = (F.col("kind") == "image") & (F.col("width") / F.col("height") >= L.WIDE_RATIO)  # in documents of columns too
    items = rows.select("doc", "page", "place", "kind", F.col("place").alias("id"), "text", "x", "y", "width", "height", (F.col("width") * 2).alias("pixels"), F.when(flat_image, ink).alias("ink"), F.lit(60).alias("ink_height"))
    found = L.image_results(items, "doc", whole_grids=False)  # the SQL groups a grid's images by ``band`` too
    return found.select("doc", "page", "chain", "place", "form", F.size("ids").alias("images"), F.round("x0", 3).alias("x0"), "y0", F.round("x1", 3).alias("x1"), "y1", "new_line", F.col("canvas.width").alias("canvas_width"), F.col("cut.start").alias("cut_start"))
