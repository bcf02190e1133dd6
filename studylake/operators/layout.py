"""Images of a page's layout: chains of neighbours, grids and rows as one image, wide option images cut by their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.arrays import bound
from studylake.functions import text as X

#: Tolerances in points and shares (fixed values): one row, one column, rows of one grid, heights of one row.
ROW_GAP, COLUMN_GAP, ROWS_APART, HEIGHT_RATIO = 25.0, 12.0, 200.0, 1.8
#: A wide image of options: its shape, its height, and how far below it the line of option letters stands (fixed values).
WIDE_RATIO, WIDE_HEIGHT, LETTERS_BELOW = 2.2, 300.0, 80.0
#: The longer side of a merged image, in pixels (fixed value).
MOST_SIDE = 3000


def option_letters(line: Column) -> Column:
    """A line of four or more option letters, with points and blanks between them."""
    return F.coalesce(F.regexp_replace(line, r"[\s.．、]", "").rlike("^[A-Da-d]{4,}$"), F.lit(False))


def _middles(ink: Column, hit, least: int) -> Column:
    """Middles of the runs of at least so many neighbouring columns that ``hit``."""

    def ends(flags: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(flags) - 1)
        edge = lambda d: F.filter(places, lambda i: F.get(flags, i) & ~F.coalesce(F.get(flags, i + d), F.lit(False)))
        runs = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(F.filter(runs, lambda r: r["b"] - r["a"] + 1 >= least), lambda r: F.floor((r["a"] + r["b"]) / 2).cast("int"))

    return bound(F.transform(ink, hit), ends)


def column_cuts(ink: Column, height: Column) -> Column:
    """Where a wide image of options is cut (columns, ascending); null if it isn't made of three to five panels.

    ``ink`` counts the dark pixels of each column.  Panels lie between bare
    columns (three or more, two per cent ink at most) or frames (two or more,
    seventy per cent at least).  The cuts inside the middle nine tenths must
    lie within two fifths of a panel of an even division, and the widest panel
    be at most 1.6 times the narrowest.
    """
    def of(ink: Column) -> Column:
        width = F.size(ink)
        fine = (width >= 200) & (height >= 20) & (width / height >= WIDE_RATIO)

        def even(cuts: Column) -> Column:
            panel = width / (F.size(cuts) + 1)
            near = F.forall(F.transform(cuts, lambda c, k: F.abs(c - panel * (k + 1)) <= panel * 0.4), lambda x: x)
            sides = F.zip_with(F.concat(cuts, F.array(width)), F.concat(F.array(F.lit(0)), cuts), lambda b, a: b - a)
            alike = bound(sides, lambda s: F.array_max(s) <= 1.6 * F.greatest(F.array_min(s), F.lit(1)))
            return F.when(F.size(cuts).between(2, 4) & near & alike, cuts)

        edge = F.greatest(F.floor(width / 20), F.lit(2))
        found = F.array_distinct(F.concat(_middles(ink, lambda x: x <= height * 0.02, 3), _middles(ink, lambda x: x >= height * 0.7, 2)))
        inner = F.array_sort(F.filter(found, lambda c: (c > edge) & (c < width - edge)))
        return F.when(fine, bound(inner, even))

    return bound(ink, of)


def image_chains(items: DataFrame, key: str) -> DataFrame:
    """Images of page items (key, page, place, kind, id, text, x, y, width, height) with chain, row, column, grid, band, wide.

    A chain is a stretch of images (numbers in circles between them don't break
    it); text and noise end it.  Rows are islands of centres no further than
    ``ROW_GAP`` apart.  ``grid``: the chain stands in two or three rows of equal
    length, aligned and near each other; ``band``: its row holds six to nine of
    like height; ``wide``: a flat image right above a line of option letters.
    Images without a box have no row.  One shuffle, by document and page.
    """
    page = [key, "page"]
    own = Window.partitionBy(*page).orderBy("place")
    after = lambda c: F.lead(c).over(own)
    boxed = (F.col("width") > 0) & (F.col("height") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    below = after("y") - F.col("y") - F.col("height")
    wide = boxed & (F.col("width") / F.col("height") >= WIDE_RATIO) & (F.col("height") <= WIDE_HEIGHT) & (after("kind") == "noise") & below.between(0, LETTERS_BELOW) & option_letters(after("text"))
    rows = items.withColumn("chain", F.count_if(F.col("kind").isin("text", "noise")).over(own)).withColumn("wide", F.coalesce(wide, F.lit(False)))
    rows = rows.filter("kind = 'image'").withColumn("boxed", F.coalesce(boxed, F.lit(False))).withColumn("cy", F.when(F.col("boxed"), F.col("y") + F.col("height") / 2))
    chain = [*page, "chain", "boxed"]
    rows = X.clusters(rows, chain, "cy", ROW_GAP).withColumn("row", F.when(F.col("boxed"), F.col("cluster"))).drop("cluster")
    whole, line, cells = Window.partitionBy(*chain), Window.partitionBy(*chain, "row"), Window.partitionBy(*chain, "column")
    rows = rows.withColumn("column", F.row_number().over(line.orderBy("x", "place"))).withColumn("n", F.count("*").over(line)).withColumn("row_cy", F.avg("cy").over(line))
    rows = rows.withColumn("off", F.abs(F.col("x") - F.min(F.when(F.col("row") == 0, F.col("x"))).over(cells)))
    rows = rows.withColumn("step", F.when(F.col("column") == 1, F.col("row_cy") - F.lag("row_cy").over(whole.orderBy("row", "column"))))
    even = (F.min("n").over(whole) == F.max("n").over(whole)) & (F.min("n").over(whole) >= 2) & (F.max("row").over(whole).between(1, 2))
    grid = even & (F.max("off").over(whole) <= COLUMN_GAP) & (F.max("step").over(whole) <= ROWS_APART)
    band = F.col("n").between(6, 9) & (F.max("height").over(line) <= HEIGHT_RATIO * F.min("height").over(line))
    rows = rows.withColumn("grid", F.col("boxed") & F.coalesce(grid, F.lit(False))).withColumn("band", F.col("boxed") & band)
    return rows.drop("off", "step", "row_cy")


def _canvas(members: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(width, height, placed) of a merged image in pixels: the middle scale of its members, its longer side bounded."""
    half = lambda v: F.floor(v + 0.5).cast("int")
    scales = F.array_sort(F.transform(F.filter(members, lambda m: m["pixels"].isNotNull()), lambda m: m["pixels"] / m["width"]))

    def at(scale: Column) -> Column:
        side = F.greatest(half((x1 - x0) * scale), half((y1 - y0) * scale), F.lit(1))
        return F.when(side > MOST_SIDE, scale * (F.lit(float(MOST_SIDE)) / side)).otherwise(scale)

    def sized(raw: Column) -> Column:
        def of(scale: Column) -> Column:
            cut = scale < raw
            long = lambda v: F.greatest(F.when(cut, F.floor(half(v * raw) * (scale / raw)).cast("int")).otherwise(half(v * raw)), F.lit(1))
            put = lambda m: F.struct(m["id"].alias("id"), half((m["x"] - x0) * scale).alias("x"), half((m["y"] - y0) * scale).alias("y"), F.greatest(half(m["width"] * scale), F.lit(1)).alias("width"), F.greatest(half(m["height"] * scale), F.lit(1)).alias("height"))
            return F.struct(long(x1 - x0).alias("width"), long(y1 - y0).alias("height"), F.transform(members, put).alias("placed"))

        return bound(at(raw), of)

    return F.when(F.size(scales) > 0, bound(F.get(scales, F.floor(F.size(scales) / 2).cast("int")), sized))


def image_results(items: DataFrame, key: str, whole_grids: bool = True) -> DataFrame:
    """key, page, chain, place, form, ids, x0, y0, x1, y1, new_line, canvas, part, cut: the images that a page's layout gives.

    ``items`` as for ``image_chains``, and ``pixels`` (an image's width in
    pixels), ``ink`` and ``ink_height`` (see ``column_cuts``), all nullable.
    A grid is one image, else a row of six to nine, else each image (``form``
    grid, row, one); a wide image alone in its row is cut into panels of equal
    width (``form`` panel, ``cut`` the first pixel column and the one after
    the last).  ``new_line``: the image stands in another row than the one
    before it.  Images without a box come after the others of their chain.
    Without ``whole_grids`` a grid's rows that would be rows of six to nine, and
    its other ones, are an image each.
    """
    rows = image_chains(items, key)
    unit_row = F.when(~F.col("grid"), F.col("row"))
    unit_column = F.when(~F.col("grid") & ~F.col("band"), F.col("column"))
    rows = rows.withColumn("unit_row", unit_row).withColumn("unit_column", unit_column).withColumn("form", F.when(F.col("grid"), "grid").when(F.col("band"), "row").otherwise("one"))
    cuts = F.when(F.col("wide") & (F.col("n") == 1) & ~F.col("grid"), column_cuts(F.col("ink"), F.col("ink_height")))
    rows = rows.withColumn("cuts", F.when(F.col("wide"), cuts)).withColumn("ink_width", F.size("ink"))
    member = F.struct("row", "column", "place", "id", "x", "y", "width", "height", "pixels")
    rows = rows.withColumn("grid_rows", F.when(F.col("grid") & F.lit(not whole_grids), F.col("band")))
    parts = rows.groupBy(key, "page", "chain", "boxed", "unit_row", "unit_column", "form", "grid_rows").agg(
        F.array_sort(F.collect_list(member)).alias("members"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"),
        F.max(F.struct("cuts", "ink_width")).alias("c"),
    )
    first = F.element_at("members", 1)
    parts = parts.withColumn("cy", F.when(F.col("boxed"), first["y"] + first["height"] / 2))
    edges = F.when(F.col("c.cuts").isNotNull(), F.concat(F.array(F.lit(0)), F.col("c.cuts"), F.array(F.col("c.ink_width"))))
    parts = parts.withColumn("edges", edges).withColumn("part", F.explode(F.sequence(F.lit(0), F.when(edges.isNotNull(), F.size(edges) - 2).otherwise(0))))
    panel = F.col("edges").isNotNull()
    share = (F.col("x1") - F.col("x0")) / F.when(panel, F.size("edges") - 1)
    left, right = F.col("x0") + F.col("part") * share, F.col("x0") + (F.col("part") + 1) * share
    order = Window.partitionBy(key, "page", "chain").orderBy(F.col("boxed").desc(), "row", "column", "first_place", "part")
    parts = parts.withColumn("row", first["row"]).withColumn("column", first["column"]).withColumn("first_place", first["place"])
    merged = F.col("form").isin("grid", "row")
    return parts.select(
        key, "page", "chain", F.row_number().over(order).alias("place"), F.when(panel, "panel").otherwise(F.col("form")).alias("form"), F.transform("members", lambda m: m["id"]).alias("ids"),
        F.when(panel, left).otherwise(F.col("x0")).alias("x0"), "y0", F.when(panel, right).otherwise(F.col("x1")).alias("x1"), "y1",
        F.coalesce(F.abs(F.col("cy") - F.lag("cy").over(order)) > ROW_GAP, F.lit(False)).alias("new_line"),
        F.when(merged, _canvas(F.col("members"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("canvas"), "part",
        F.when(panel, F.struct(F.get("edges", F.col("part")).alias("start"), F.get("edges", F.col("part") + 1).alias("end"))).alias("cut"),
    )
