"""Queries over polygons with holes and parts, as WKT texts made of the part table's boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.operators import planar, shapes
from landmosaic.plans.reference import BOX, PTS, Tables, c, lit, q, r6
from landmosaic.runtime import width

#: Box with a centred hole of half its size; every fifth has a second part of 10 x 10, 12 above.
_W, _H = "(xmax - xmin)", "(ymax - ymin)"


def _ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("(%.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f)", x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def holed(t: Tables) -> DataFrame:
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    one = F.concat(lit("("), _ring(c("xmin"), c("ymin"), c("xmax"), c("ymax")), lit(", "), _ring(c("xmin") + w / 4, c("ymin") + h / 4, c("xmax") - w / 4, c("ymax") - h / 4), lit(")"))
    two = F.concat(lit("("), _ring(c("xmin"), c("ymax") + 12, c("xmin") + 10, c("ymax") + 22), lit(")"))
    # few bytes, much work: one small file would be one task
    return t.box.repartition(width(t.box), "id").withColumn("wkt", F.when(c("id") % 5 == 0, F.concat(lit("MULTIPOLYGON ("), one, lit(", "), two, lit(")"))).otherwise(F.concat(lit("POLYGON "), one)))


def _measured(t: Tables) -> DataFrame:
    return holed(t).select("id", "xmin", "ymin", "xmax", "ymax", shapes.measures("wkt").alias("m"))


_TWO = "CASE WHEN id % 5 = 0 THEN {0} ELSE 0 END"
q("G01", f"SELECT id, round(0.75 * {_W} * {_H} + {_TWO.format(100)}, 6) AS area FROM {BOX}")(lambda t: _measured(t).select("id", r6(c("m.area"), "area")))
q("G02", f"SELECT id, round(3.0 * ({_W} + {_H}) + {_TWO.format(40)}, 6) AS perimeter FROM {BOX}")(lambda t: _measured(t).select("id", r6(c("m.perimeter"), "perimeter")))
q("G05", f"SELECT id, round(CASE WHEN id % 5 = 0 THEN ((xmin + xmax) / 2 * a + (xmin + 5) * 100) / (a + 100) ELSE (xmin + xmax) / 2 END, 6) AS cx, round(CASE WHEN id % 5 = 0 THEN ((ymin + ymax) / 2 * a + (ymax + 17) * 100) / (a + 100) ELSE (ymin + ymax) / 2 END, 6) AS cy FROM (SELECT *, 0.75 * {_W} * {_H} AS a FROM {BOX})")(
    lambda t: _measured(t).select("id", r6(c("m.cx"), "cx"), r6(c("m.cy"), "cy"))
)
q("G06", f"SELECT id, round(xmin + {_W} / 8, 6) AS px, round((ymin + ymax) / 2, 6) AS py FROM {BOX} WHERE id % 5 <> 0")(lambda t: _measured(t).where("id % 5 != 0").select("id", r6(c("m.px"), "px"), r6(c("m.py"), "py")))
q("G07", f"SELECT id, CAST(8 + {_TWO.format(4)} AS INTEGER) AS vertices, CAST(10 + {_TWO.format(5)} AS INTEGER) AS with_closing FROM {BOX}")(lambda t: _measured(t).select("id", c("m.vertices").alias("vertices"), (c("m.vertices") + 2 + F.when(c("id") % 5 == 0, 1).otherwise(0)).alias("with_closing")))
q("G08", f"SELECT id, round({_W} * {_H}, 6) AS hull_area, 0.75::DOUBLE AS solidity FROM {BOX} WHERE id % 5 <> 0")(lambda t: _measured(t).where("id % 5 != 0").select("id", r6(c("m.hull_area"), "hull_area"), r6(c("m.area") / c("m.hull_area"), "solidity")))


def _faulty(t: Tables) -> DataFrame:
    """By id modulo 6: sound, crossing itself, not closed, with a repeated point, a collection of a point and a box, with too few points."""
    x0, y0, x1, y1 = c("xmin"), c("ymin"), c("xmax"), c("ymax")
    open_ = lambda *p: F.format_string("POLYGON ((" + ", ".join(["%.3f %.3f"] * (len(p) // 2)) + "))", *p)
    kinds = [
        F.concat(lit("POLYGON ("), _ring(x0, y0, x1, y1), lit(")")), open_(x0, y0, x1, y1, x1, y0, x0, y1, x0, y0), open_(x0, y0, x1, y0, x1, y1, x0, y1), open_(x0, y0, x1, y0, x1, y0, x1, y1, x0, y1, x0, y0),
        F.concat(F.format_string("GEOMETRYCOLLECTION (POINT (%.3f %.3f), POLYGON (", x0, y0), _ring(x0, y0, x1, y1), lit("))")), open_(x0, y0, x1, y0, x0, y0),
    ]
    return t.box.repartition(width(t.box), "id").withColumn("wkt", F.element_at(F.array(*kinds), (c("id") % 6 + 1).cast("int")))


q("G10", f"SELECT id, CASE id % 6 WHEN 1 THEN 'self-crossing' WHEN 2 THEN 'not closed' WHEN 3 THEN 'repeated point' WHEN 5 THEN 'too few points' END AS fault FROM {BOX}")(lambda t: _faulty(t).select("id", shapes.measures("wkt")["fault"].alias("fault")))
q("G11", f"SELECT id, CASE WHEN id % 6 IN (1, 5) THEN NULL ELSE round({_W} * {_H}, 6) END AS area FROM {BOX}")(lambda t: _faulty(t).withColumn("good", shapes.made_valid("wkt")).select("id", r6(shapes.measures("good")["area"], "area")))
q("G12", f"SELECT id, CASE WHEN id % 6 = 4 THEN 'GEOMETRYCOLLECTION,POINT,POLYGON' ELSE 'POLYGON' END AS kinds, 1 AS parts, 'MULTIPOLYGON' AS kept FROM {BOX} WHERE id % 6 IN (0, 3, 4)")(
    lambda t: _faulty(t).where("id % 6 IN (0, 3, 4)").withColumn("good", shapes.made_valid("wkt")).select("id", shapes.measures("wkt")["kinds"].alias("kinds"), shapes.measures("good")["parts"].alias("parts"), shapes.measures("good")["kinds"].alias("kept"))
)
_IN = (3000.0, 3000.0, 6000.0, 6000.0)
_HOLE = "SELECT id, xmin, ymin, xmax, ymax, xmin + (xmax - xmin) / 4 AS hx0, ymin + (ymax - ymin) / 4 AS hy0, xmax - (xmax - xmin) / 4 AS hx1, ymax - (ymax - ymin) / 4 AS hy1 FROM " + BOX + " WHERE id % 5 <> 0"
_CUT = lambda a, b, c_, d: f"greatest(0, least({c_}, 6000) - greatest({a}, 3000)) * greatest(0, least({d}, 6000) - greatest({b}, 3000))"


def _cut(t: Tables) -> DataFrame:
    return shapes.region_cut(holed(t).where("id % 5 != 0").select("id", "wkt"), "wkt", _IN)


q("G15", f"SELECT id, round({_CUT('xmin', 'ymin', 'xmax', 'ymax')} - {_CUT('hx0', 'hy0', 'hx1', 'hy1')}, 4) AS area FROM ({_HOLE}) WHERE {_CUT('xmin', 'ymin', 'xmax', 'ymax')} > 0")(lambda t: _cut(t).select("id", F.round(shapes.measures("wkt")["area"], 4).alias("area")))
q("G16", f"SELECT id, xmin >= 3000 AND ymin >= 3000 AND xmax <= 6000 AND ymax <= 6000 AS covered FROM ({_HOLE}) WHERE {_CUT('xmin', 'ymin', 'xmax', 'ymax')} > 0")(lambda t: _cut(t).select("id", "covered"))


def _simplified(t: Tables) -> DataFrame:
    """Lines with id % 9 extra points on their first leg and a corner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "points": [len(shapes.simplify(shapes.parse(w).lines[0], 0.5)) for w in b["wkt"]]}).astype({"points": "int32"})

    leg = F.transform(F.sequence(lit(0), (c("id") % 9 + 1).cast("int")), lambda i: F.format_string("%d %d", i * 10, i * 5))
    wkt = F.concat(lit("LINESTRING ("), F.array_join(leg, ", "), lit(", 200 0)"))
    return t.pts.select("id", wkt.alias("wkt")).mapInPandas(run, "id bigint, points int")


q("G19", f"SELECT id, 3 AS points FROM {PTS}")(_simplified)
q("G21", f"SELECT id, round(least({_W}, {_H}) / 4, 6) AS in_hole, round(-least({_W}, {_H}) / 8, 6) AS in_part FROM {BOX} WHERE id % 5 <> 0")(
    lambda t: holed(t).where("id % 5 != 0").select(
        "id", r6(shapes.distance_to("wkt", (c("xmin") + c("xmax")) / 2, (c("ymin") + c("ymax")) / 2), "in_hole"),
        r6(shapes.distance_to("wkt", F.when(c("xmax") - c("xmin") <= c("ymax") - c("ymin"), c("xmin") + (c("xmax") - c("xmin")) / 8).otherwise((c("xmin") + c("xmax")) / 2), F.when(c("xmax") - c("xmin") <= c("ymax") - c("ymin"), (c("ymin") + c("ymax")) / 2).otherwise(c("ymin") + (c("ymax") - c("ymin")) / 8)), "in_part"),
    )
)
q("G22", f"SELECT id, 'POINT (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM {PTS}")(lambda t: t.pts.select("id", F.format_string("POINT (%.0f %.0f)", "x", "y").alias("wkt")))
_TXT = "printf('%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f', xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax)"
q("G23", f"SELECT id, sha256({_TXT}) AS hash FROM {BOX}")(lambda t: t.box.select("id", F.sha2(F.format_string("%.2f %.2f,%.2f %.2f,%.2f %.2f,%.2f %.2f", "xmin", "ymin", "xmax", "ymin", "xmax", "ymax", "xmin", "ymax"), 256).alias("hash")))


def _bent(t: Tables) -> DataFrame:
    """Regular points on lines with a right-angled bend."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x, y in zip(b["id"], b["x"], b["y"]):
                a, leg = np.array([[x, y], [x + i % 40, y], [x + i % 40, y + i % 25]]), i
                at, p = shapes.regular_points(a, 10.0)
                out += [(leg, d, px, py) for d, (px, py) in zip(at, p)]
            yield pd.DataFrame(out, columns=["id", "distance", "x", "y"])

    return t.pts.select("id", "x", "y").mapInPandas(run, "id bigint, distance double, x double, y double").select("id", "distance", r6(c("x"), "x"), r6(c("y"), "y"))


q("G24", f"SELECT id, (i + 0.5::DOUBLE) * 10 AS distance, round(x + least((i + 0.5::DOUBLE) * 10, id % 40), 6) AS x, round(y + greatest(0, (i + 0.5::DOUBLE) * 10 - id % 40), 6) AS y FROM {PTS}, range(10) r(i) WHERE (i + 0.5) * 10 <= id % 40 + id % 25")(_bent)
q("G26", f"SELECT id FROM {PTS} WHERE x BETWEEN 2000 AND 4000 AND y BETWEEN 1000 AND 5000")(lambda t: t.pts.where(c("x").between(2000, 4000) & c("y").between(1000, 5000)).select("id"))
_SHARE = f"(SELECT id, greatest(0, least(1, {_CUT('xmin', 'ymin', 'xmax', 'ymax')} / {_W} / {_H})) AS share, (xmin + xmax) / 2 BETWEEN 3000 AND 6000 AND (ymin + ymax) / 2 BETWEEN 3000 AND 6000 AS inside FROM {BOX})"
q("G25", f"SELECT id, round(share, 6) AS share, inside OR share >= 0.5 AS kept, share > 0 AND share < 1 AS crossing FROM {_SHARE}")(lambda t: _shared(t))


def _shared(t: Tables) -> DataFrame:
    """Share of a footprint in a region; kept if its representative point or at least half of it lies inside."""
    b = t.box.withColumn("wkt", F.concat(lit("POLYGON ("), _ring(c("xmin"), c("ymin"), c("xmax"), c("ymax")), lit(")")))
    whole = b.select("id", shapes.measures("wkt").alias("m")).select("id", "m.area", "m.px", "m.py")
    part = shapes.region_cut(b.select("id", "wkt"), "wkt", _IN).select("id", shapes.measures("wkt")["area"].alias("cut"))
    share = F.least(lit(1.0), F.greatest(lit(0.0), F.coalesce("cut", lit(0.0)) / c("area")))
    inside = c("px").between(_IN[0], _IN[2]) & c("py").between(_IN[1], _IN[3])
    return whole.join(part, "id", "left").withColumn("share", share).select("id", r6(c("share"), "share"), (inside | (c("share") >= 0.5)).alias("kept"), ((c("share") > 0) & (c("share") < 1)).alias("crossing"))


q("G17", f"SELECT kind, CAST(count(DISTINCT (x + i, y + j)) AS DOUBLE) AS area FROM (SELECT kind, CAST(xmin AS BIGINT) % 400 AS x, CAST(ymin AS BIGINT) % 400 AS y, CAST(xmax - xmin AS BIGINT) AS w, CAST(ymax - ymin AS BIGINT) AS h FROM {BOX}), range(60) a(i), range(60) b(j) WHERE i < w AND j < h GROUP BY 1")(lambda t: _dissolved(t))


def _dissolved(t: Tables) -> DataFrame:
    """Boxes of a kind, moved together so that many overlap, as one area."""
    x, y = c("xmin") % 400, c("ymin") % 400
    b = t.box.select("kind", x.alias("xmin"), y.alias("ymin"), (x + c("xmax") - c("xmin")).alias("xmax"), (y + c("ymax") - c("ymin")).alias("ymax"))
    return planar.dissolved_area(b, "kind", 200.0)
