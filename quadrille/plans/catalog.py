"""Named queries over the driver's tables, with the SQL that they must agree with.

A key begins with the inventory's identifier. Results are rounded to six places, as the order of
sums differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import bandmath, scalar
from quadrille.operators import components, geo, image, project, reduce, roi, stencil
from quadrille.plans.graph import Graph
from quadrille.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WITH = """
WITH e AS (SELECT vec_id::INT AS y, unnest(range(len(embedding)))::INT AS x, unnest(embedding)::DOUBLE AS v FROM embeddings),
     p AS (SELECT * FROM e),
     z AS (SELECT coalesce(max(y), -1) + 1 AS h FROM p),
     cube AS (SELECT y AS z, x // 8 AS y, x % 8 AS x, v FROM e),
     spectral AS (SELECT y, x AS channel, x * 10.0::DOUBLE + 400 AS centre, v FROM e),
     dem AS (SELECT l_partkey::INT AS y, l_linenumber - 1 AS x, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
     events_grid AS (SELECT day(ts) - 1 AS y, hour(ts) AS x, sum(value) AS v FROM events GROUP BY ALL)
"""


def r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def R(c: str) -> str:  # noqa: N802
    return f"round({c}, 6) + 0"


def plane(spark: SparkSession, sf: str) -> DataFrame:
    """The whole plane: lines of 64."""
    return t.emb_plane(spark, sf)


def height(spark: SparkSession, sf: str) -> int:
    """Lines of :func:`plane`."""
    return t.emb_rows(spark, sf).agg(F.coalesce(F.max("y"), F.lit(-1)) + 1).first()[0]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            head = sql.lstrip()
            ORACLES[name] = _WITH + (", " + head[5:].lstrip() if head.upper().startswith("WITH ") else sql)
        return f

    return add


def samples(df: DataFrame) -> DataFrame:
    return df.select("y", "x", r(F.col("v").cast("double")).alias("v"))


STATS = ["n", "finite", "invalid", "minimum", "maximum", "mean", "deviation", "variance"]
STATS_SQL = f"count(*) AS n, count(v) AS finite, count(*) - count(v) AS invalid, {R('min(v)')} AS minimum, {R('max(v)')} AS maximum, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS deviation, {R('var_pop(v)')} AS variance"


def stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return reduce.statistics(df, by).select(*(by or []), *STATS[:3], *[r(c).alias(c) for c in STATS[3:]])


@query("slice0_crop_statistics", f"SELECT {STATS_SQL} FROM e WHERE y BETWEEN 10 AND 109 AND x BETWEEN 8 AND 39 AND v > -0.2")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Crop in vector form, a validity threshold, statistics."""
    return stats(project.crop_lines(t.emb_rows(spark, sf), 8, 10, 32, 100).filter("v > -0.2"))


@query("prj02_crop", f"SELECT y - 10 AS y, x - 8 AS x, {R('v')} AS v FROM e WHERE y BETWEEN 10 AND 109 AND x BETWEEN 8 AND 39")
def _(spark, sf):
    return samples(project.crop_lines(t.emb_rows(spark, sf), 8, 10, 32, 100))


@query("prj01_select_level", f"SELECT y // 2 AS y, x // 2 AS x, {R('avg(v)')} AS v FROM p WHERE y // 2 < (SELECT h FROM z) // 2 GROUP BY ALL")
def _(spark, sf):
    p = plane(spark, sf)
    half = stencil.filter_axis(stencil.filter_axis(p, "x", stencil.box_taps(64, 2)), "y", stencil.box_taps(height(spark, sf), 2))
    return samples(project.select_level(p.withColumn("level", F.lit(0)).unionByName(half.withColumn("level", F.lit(1))), 1))


@query("prj04_slice", f"SELECT x AS y, z AS x, {R('v')} AS v FROM cube WHERE y = 3")
def _(spark, sf):
    return samples(project.slice_plane(t.emb_cube(spark, sf), ("z", "x"), {"y": 3}))


@query("src22_series", f"SELECT z AS at, {R('v')} AS v FROM cube WHERE y = 2 AND x = 5")
def _(spark, sf):
    return project.series(t.emb_cube(spark, sf), "z", {"y": 2, "x": 5}).select("at", r("v").alias("v"))


for _mode, _sql, _args in (
    ("greater-than", "v > 0.1", (0.1,)),
    ("greater-or-equal", "v >= 0.1", (0.1,)),
    ("less-than", "v < 0.0", (0.0,)),
    ("less-or-equal", "v <= 0.0", (0.0,)),
    ("inside", "v BETWEEN -0.05 AND 0.05", (-0.05, 0.05)),
    ("outside", "NOT v BETWEEN -0.05 AND 0.05", (-0.05, 0.05)),
):
    query(f"flt01_threshold_{_mode.replace('-', '_')}", f"SELECT y, x, (CASE WHEN v IS NULL THEN 0 WHEN {_sql} THEN 1 ELSE 0 END)::INT AS v FROM p")(lambda spark, sf, m=_mode, a=_args: project.threshold(plane(spark, sf), m, *a).select("y", "x", "v"))

query("flt03_usable", "SELECT count(*) FILTER (v > 0 AND v <> 100) AS usable, count(*) FILTER (NOT (v > 0 AND v <> 100)) AS rest FROM events_grid")(
    lambda spark, sf: t.event_grid(spark, sf).select(scalar.usable(F.when(F.col("v") > 0, F.col("v")), 100.0).alias("u")).agg(F.count_if("u").alias("usable"), F.count_if(~F.col("u")).alias("rest"))
)
query("flt06_rectangle", f"SELECT {STATS_SQL} FROM p WHERE x + 0.5 >= 3.5 AND x + 0.5 < 20.5 AND y + 0.5 >= 2 AND y + 0.5 < 77.25")(lambda spark, sf: stats(plane(spark, sf).filter(roi.rectangle(3.5, 2, 17, 75.25))))
query("flt07_ellipse", f"SELECT {STATS_SQL} FROM p WHERE pow((x + 0.5 - 30) / 20, 2) + pow((y + 0.5 - 80) / 50.5, 2) <= 1")(lambda spark, sf: stats(plane(spark, sf).filter(roi.ellipse(30, 80, 20, 50.5))))
_POLY = [(2.0, 3.0), (50.0, 10.0), (30.5, 60.0), (60.0, 120.0), (10.0, 100.5)]
_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_POLY, [*_POLY[1:], _POLY[0]]))
query(
    "flt08_polygon",
    f"""WITH g(x1, y1, x2, y2) AS (VALUES {_EDGES}), l AS (SELECT DISTINCT y FROM p),
    c AS (SELECT y, x1 + (y + 0.5 - y1) * (x2 - x1) / (y2 - y1) AS pos FROM l, g WHERE y1 <> y2 AND y + 0.5 >= least(y1, y2) AND y + 0.5 < greatest(y1, y2)),
    o AS (SELECT y, pos, row_number() OVER (PARTITION BY y ORDER BY pos) AS k FROM c),
    s AS (SELECT a.y, a.pos AS lo, b.pos AS hi FROM o a JOIN o b ON a.y = b.y AND b.k = a.k + 1 WHERE a.k % 2 = 1)
    SELECT {STATS_SQL} FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.y = p.y AND p.x >= ceil(s.lo - 0.5) AND p.x <= floor(s.hi - 0.5))""",
)(lambda spark, sf: stats(roi.within_polygon(plane(spark, sf), _POLY, height(spark, sf))))
query("set01_roi_union", f"SELECT {STATS_SQL} FROM p WHERE (x < 10 AND y < 50) OR pow(x + 0.5 - 20, 2) / 100 + pow(y + 0.5 - 40, 2) / 400 <= 1")(lambda spark, sf: stats(plane(spark, sf).filter(roi.rectangle(0, 0, 10, 50) | roi.ellipse(20, 40, 10, 20))))


@query("flt10_classify", "SELECT label AS v, count(*) AS n, (label * 37) % 256 AS r, (label * 91) % 256 AS g, (label * 53) % 256 AS b FROM embeddings GROUP BY label")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("v"))
    k = F.col("id").cast("int")
    classes = spark.range(1000).select(k.alias("v"), ((k * 37) % 256).alias("r"), ((k * 91) % 256).alias("g"), ((k * 53) % 256).alias("b"))
    return project.classify(labels, classes).groupBy("v", "r", "g", "b").agg(F.count("*").alias("n"))


def _four(spark, sf):
    """Four bands of 16 columns, side by side without a join."""
    p = plane(spark, sf)
    return p.groupBy("y", (F.col("x") % 16).alias("x")).agg(*[F.max(F.when(F.expr(f"x DIV 16 = {k}"), F.col("v"))).alias(n) for k, n in enumerate(("red", "green", "blue", "nir"))])


_FOUR = "b AS (SELECT y, x % 16 AS x, max(v) FILTER (x // 16 = 0) AS red, max(v) FILTER (x // 16 = 1) AS green, max(v) FILTER (x // 16 = 2) AS blue, max(v) FILTER (x // 16 = 3) AS nir FROM p GROUP BY ALL)"
_MATH = "max(red * 2, nir) + abs(green) / (blue * blue + 1) - min(min(red, blue), nir) * 0.5"
query("jon01_band_math", f"WITH {_FOUR} SELECT y, x, {R('greatest(red * 2, nir) + abs(green) / (blue * blue + 1) - least(red, blue, nir) * 0.5')} AS v FROM b")(
    lambda spark, sf: samples(_four(spark, sf).withColumn("v", bandmath.compile_expression(_MATH, {n: F.col(n) for n in ("red", "green", "blue", "nir")})))
)
query("fn02_functions", f"WITH {_FOUR} SELECT y, x, CASE WHEN red > 0 AND nir >= 0 THEN {R('ln(red) + sqrt(nir) + exp(blue) + pow(green, 2)')} END AS v FROM b")(
    lambda spark, sf: samples(_four(spark, sf).withColumn("v", bandmath.compile_expression("log(red) + sqrt(nir) + exp(blue) + pow(green, 2)", {n: F.col(n) for n in ("red", "green", "blue", "nir")})))
)
query("fn04_normalised_difference", f"WITH {_FOUR} SELECT y, x, {R('(nir - red) / nullif(nir + red, 0)')} AS v FROM b WHERE abs(nir + red) > 0.001")(
    lambda spark, sf: samples(_four(spark, sf).filter("abs(nir + red) > 0.001").withColumn("v", scalar.normalised_difference(F.col("nir"), F.col("red"))))
)
query("fn05_linear_combination", f"WITH {_FOUR} SELECT y, x, {R('0.3 * red + 0.59 * green + 0.11 * blue + 1')} AS v FROM b")(
    lambda spark, sf: samples(_four(spark, sf).withColumn("v", scalar.linear_combination([(0.3, F.col("red")), (0.59, F.col("green")), (0.11, F.col("blue"))], 1)))
)
query("fn06_subtraction", f"SELECT a.y, a.x, {R('a.v - b.v')} AS v FROM p a JOIN (SELECT y - 1 AS y, x, v FROM e WHERE y >= 1) b ON a.y = b.y AND a.x = b.x")(
    lambda spark, sf: samples(project.join_planes({"a": plane(spark, sf), "b": project.crop(t.emb_plane(spark, sf), 0, 1, 64, height(spark, sf) - 1)}).withColumn("v", F.col("a") - F.col("b")))
)
query("jon02_coverage", "SELECT x.x::INT AS x, y.y::INT AS y FROM (SELECT unnest(range(7)) AS x) x, (SELECT unnest(range((SELECT max(y) + 1 FROM dem))) AS y) y WHERE NOT EXISTS (SELECT 1 FROM dem d WHERE d.x = x.x AND d.y = y.y)")(
    lambda spark, sf: project.uncovered(d := t.dem(spark, sf), 7, d.agg(F.coalesce(F.max("y"), F.lit(-1)) + 1).first()[0]).select("x", "y")
)

query("agg01_statistics", f"SELECT {STATS_SQL} FROM e")(lambda spark, sf: stats(t.emb_plane(spark, sf)))
query("agg12_region_statistics", f"SELECT label, {STATS_SQL} FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label")(
    lambda spark, sf: stats(spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double")), ["label"])
)
_PS = [0, 1, 5, 25, 50, 75, 95, 99, 100]
query("agg03_percentiles", f"WITH o AS (SELECT list(v ORDER BY v) AS l FROM e), w(p) AS (VALUES {', '.join(f'({p}::DOUBLE)' for p in _PS)}) SELECT p, {R('l[floor(p / 100 * (len(l) - 1) + 0.5)::BIGINT + 1]')} AS value FROM o, w")(
    lambda spark, sf: reduce.percentiles(t.emb_plane(spark, sf), _PS).select("p", r("value").alias("value"))
)


def _histogram_sql(bins: int, low: str, high: str) -> str:
    return f"""WITH m AS (SELECT {low} AS lo, {high} AS hi FROM e),
    c AS (SELECT CASE WHEN v < lo THEN -1 WHEN v > hi THEN {bins} WHEN v = hi THEN {bins - 1} ELSE floor((v - lo) / ((hi - lo) / {bins})) END::BIGINT AS bin, count(*) AS n FROM e, m GROUP BY 1)
    SELECT b.bin, {R(f'lo + b.bin * (hi - lo) / {bins}')} AS low, {R(f'lo + (b.bin + 1) * (hi - lo) / {bins}')} AS high, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(-1, {bins + 1})) AS bin) b CROSS JOIN m LEFT JOIN c USING (bin)"""


def _histogram(df):
    return df.select("bin", r("low").alias("low"), r("high").alias("high"), "n")


query("agg04_histogram_auto", _histogram_sql(40, "min(v)", "max(v)"))(lambda spark, sf: _histogram(reduce.histogram(t.emb_plane(spark, sf), 40)))
query("agg04_histogram_range", _histogram_sql(10, "any_value(-0.1::DOUBLE)", "any_value(0.15::DOUBLE)"))(lambda spark, sf: _histogram(reduce.histogram(t.emb_plane(spark, sf), 10, -0.1, 0.15)))

for _how, _f in (("max", "max"), ("min", "min"), ("mean", "avg")):
    query(f"agg06_projection_{_how}", f"SELECT y, x, {R(f'{_f}(v)')} AS v FROM cube GROUP BY y, x")(lambda spark, sf, h=_how: samples(reduce.project(t.emb_cube(spark, sf), ["y", "x"], h)))
query("agg06_projection_propagate", f"SELECT x, CASE WHEN count(*) = count(w) THEN {R('max(w)')} END AS v FROM (SELECT x, CASE WHEN y % 97 <> 0 THEN v END AS w FROM dem) GROUP BY x")(
    lambda spark, sf: reduce.project(t.dem(spark, sf).withColumn("v", F.when(F.col("y") % 97 != 0, F.col("v"))), ["x"], "max", "propagate").select("x", r("v").alias("v"))
)
query("agg08_volume_slice_xz", f"SELECT z AS y, x, {R('v')} AS v FROM cube WHERE y = 1")(lambda spark, sf: samples(project.slice_plane(t.emb_cube(spark, sf), ("x", "z"), {"y": 1})))
query("agg13_measure_plane", f"WITH o AS (SELECT list(v ORDER BY v) AS l FROM p WHERE (y * 64 + x) % (SELECT greatest(1, (count(*) + 65535) // 65536) FROM p) = 0) SELECT {R('l[floor(0.01 * (len(l) - 1) + 0.5)::BIGINT + 1]')} AS black, {R('l[floor(0.99 * (len(l) - 1) + 0.5)::BIGINT + 1]')} AS white FROM o")(
    lambda spark, sf: reduce.measure(plane(spark, sf), 64).select(r("black").alias("black"), r("white").alias("white"))
)
query("agg15_spectral_integral", f"WITH w AS (SELECT y, (v + lag(v) OVER q) * 0.5 * (centre - lag(centre) OVER q) AS part FROM spectral WHERE centre BETWEEN 455 AND 700 WINDOW q AS (PARTITION BY y ORDER BY centre)) SELECT y, {R('sum(part)')} AS v FROM w GROUP BY y")(
    lambda spark, sf: reduce.integrate(t.emb_spectral(spark, sf), ["y"], 455, 700).select("y", r("v").alias("v"))
)
query("jon09_nearest_channel", "SELECT w, arg_min(channel, abs(centre - w) * 1000 + channel) AS channel FROM (SELECT DISTINCT channel, centre FROM spectral) c, (VALUES (655.0), (401.0), (2000.0)) v(w) GROUP BY w")(
    lambda spark, sf: _nearest(t.emb_spectral(spark, sf).select("channel", "centre").distinct())
)


def _nearest(channels: DataFrame) -> DataFrame:
    out = None
    for w in (655.0, 401.0, 2000.0):
        one = reduce.nearest_channel(channels, w).select(F.lit(w).alias("w"), "channel")
        out = one if out is None else out.union(one)
    return out


query("fn07_band_ratio", f"SELECT a.y, {R('a.v / b.v')} AS v FROM spectral a JOIN spectral b ON a.y = b.y WHERE a.channel = 30 AND b.channel = 12 AND abs(b.v) > 0.0001")(
    lambda spark, sf: reduce.bands(t.emb_spectral(spark, sf), ["y"], {"a": 30, "b": 12}).filter("abs(b) > 0.0001").select("y", r(scalar.ratio(F.col("a"), F.col("b"))).alias("v"))
)
query("jon07_composite", f"SELECT y, {R('max(v) FILTER (channel = 25)')} AS r, {R('max(v) FILTER (channel = 15)')} AS g, {R('max(v) FILTER (channel = 5)')} AS b FROM spectral GROUP BY y")(
    lambda spark, sf: reduce.bands(t.emb_spectral(spark, sf), ["y"], {"r": 25, "g": 15, "b": 5}).select("y", *[r(c).alias(c) for c in "rgb"])
)

_PLAN = roi.line_samples([(2.5, 3.5), (40.0, 90.0), (60.25, 20.0)], 1.5)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)


def _contributors_sql(samples, method: str, centre: float) -> str:
    """``l``: the pixels that each sample of a line reads, with their weights."""
    at = f"s(k, distance, px, py) AS (VALUES {_values([(k, float(d), float(px), float(py)) for k, d, px, py in samples])})"
    if method == "nearest":
        shift = 0 if centre else 0.5
        return f"{at}, l AS (SELECT k, distance, floor(py + {shift}) AS y, floor(px + {shift}) AS x, 1.0::DOUBLE AS w FROM s)"
    return f"""{at}, u AS (SELECT k, distance, px - {centre} AS fx, py - {centre} AS fy FROM s),
    l AS (SELECT k, distance, floor(fy) + j AS y, floor(fx) + i AS x, (CASE i WHEN 0 THEN floor(fx) + 1 - fx ELSE fx - floor(fx) END) * (CASE j WHEN 0 THEN floor(fy) + 1 - fy ELSE fy - floor(fy) END) AS w FROM u, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""


for _m in ("nearest", "bilinear"):
    query(f"smp01_line_profile_{_m}", f"WITH {_contributors_sql(_PLAN, _m, 0.5)} SELECT k, {R('any_value(distance)')} AS distance, {R('sum(p.v * w)')} AS v FROM l LEFT JOIN p ON p.y = l.y AND p.x = l.x GROUP BY k")(
        lambda spark, sf, m=_m: roi.profile(plane(spark, sf), _PLAN, m).select("k", r("distance").alias("distance"), r("v").alias("v"))
    )
_RASTER = [(k, float(k), 5.0 + k * 0.7, 10.0 + k * 1.3) for k in range(60)]
query("smp03_raster_profile", f"WITH {_contributors_sql(_RASTER, 'bilinear', 0.0)} SELECT k, {R('any_value(distance)')} AS distance, {R('sum(p.v * w) / sum(w)')} AS v FROM l JOIN p ON p.y = l.y AND p.x = l.x GROUP BY k")(
    lambda spark, sf: roi.profile(plane(spark, sf), _RASTER, "bilinear", 0.0, 0.5).select("k", r("distance").alias("distance"), r("v").alias("v"))
)


# Kernels in SQL, so that what the queries are held to is worked out apart from them: ``i, k, w`` for
# the target's place, the source's and the weight; ``n`` and ``m`` are the lengths of source and target.


def _places(n: str, m: str) -> str:
    return f"(SELECT i, (i + 0.5::DOUBLE) * ({n}) / ({m}) - 0.5 AS pos FROM (SELECT unnest(range(({m})::BIGINT))::INT AS i))"


def _nearest_sql(n: str, m: str) -> str:
    return f"(SELECT i, greatest(0, least(({n}) - 1, floor(pos + 0.5)))::INT AS k, 1.0::DOUBLE AS w FROM {_places(n, m)})"


def _linear_sql(n: str, m: str) -> str:
    return f"(SELECT i, greatest(0, least(({n}) - 1, floor(pos) + d))::INT AS k, sum(CASE d WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END) AS w FROM {_places(n, m)}, (VALUES (0), (1)) b(d) GROUP BY ALL)"


def _lanczos_sql(n: str, m: str) -> str:
    wide = f"(3 / least(1.0::DOUBLE, ({m})::DOUBLE / ({n})))"
    near = f"(SELECT i, pos, unnest(range(ceil(pos - {wide})::BIGINT, floor(pos + {wide})::BIGINT + 1)) AS j FROM {_places(n, m)})"
    sinc = f"(SELECT i, j, (j - pos) * 3 / {wide} AS t FROM {near})"
    weigh = f"(SELECT i, j, CASE WHEN abs(t) < 1e-12 THEN 1 WHEN abs(t) >= 3 THEN 0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END AS w FROM {sinc})"
    return f"(SELECT i, greatest(0, least(({n}) - 1, j))::INT AS k, sum(w) / sum(sum(w)) OVER (PARTITION BY i) AS w FROM {weigh} GROUP BY i, 2)"


def _gaussian_sql(n: str, border: str) -> str:
    """Standard deviation 1.5: five places on each side."""
    bell = "(SELECT d, exp(-d * d / 4.5) / sum(exp(-d * d / 4.5)) OVER () AS w FROM (SELECT unnest(range(-5, 6))::DOUBLE AS d))"
    at = {"clamp": f"greatest(0, least(({n}) - 1, i + d))", "mirror": f"CASE WHEN i + d < 0 THEN -(i + d) WHEN i + d >= ({n}) THEN 2 * (({n}) - 1) - (i + d) ELSE i + d END", "constant": "i + d"}[border]
    return f"(SELECT i, ({at})::INT AS k, sum(w) AS w FROM (SELECT unnest(range(({n})::BIGINT))::INT AS i), {bell} GROUP BY ALL)"


_H = "(SELECT h FROM z)"


def _separable_sql(tx: str, ty: str, base: str = "p", constant: float = 0.0, value: str = "sum(v * w){rest}") -> str:
    """A filter along lines, then one along columns; what is missing of a kernel counts as ``constant``."""
    rest = f" + (1 - sum(w)) * {constant}" if constant else ""
    out = value.format(rest=rest)
    return f"WITH tx AS {tx}, ty AS {ty}, a AS (SELECT y, i AS x, sum(v * w){rest} AS v FROM {base} JOIN tx ON x = k GROUP BY y, i) SELECT i AS y, x, {R(out) if out.startswith('sum') else out} AS v FROM a JOIN ty ON y = k GROUP BY i, x"


for _m, _k in (("nearest", _nearest_sql), ("bilinear", _linear_sql)):
    query(f"smp05_resample_{_m}", _separable_sql(_k("64", "40"), _k(_H, "90")))(lambda spark, sf, m=_m: samples(stencil.resample(plane(spark, sf), (64, height(spark, sf)), (40, 90), m)))
# a reduction averages whole boxes of lines first: of the largest power of two up to the ratio that divides the height
_BOX = f"(SELECT max(f) FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS f) WHERE {_H} % f = 0 AND (f = 1 OR f <= {_H} / 150.0))"
query("stn10_resize_lanczos3", _separable_sql(_lanczos_sql("64", "100"), _lanczos_sql(f"({_H} // {_BOX})", "150"), f"(SELECT x, (y // {_BOX})::INT AS y, avg(v) AS v FROM p GROUP BY ALL)"))(lambda spark, sf: samples(stencil.resize(plane(spark, sf), (64, height(spark, sf)), (100, 150))))
query("stn12_box_shrink", f"SELECT y // 4 AS y, x // 4 AS x, {R('avg(v)')} AS v FROM p WHERE y // 4 < {_H} // 4 GROUP BY ALL")(lambda spark, sf: samples(stencil.filter_axis(stencil.filter_axis(plane(spark, sf), "x", stencil.box_taps(64, 4)), "y", stencil.box_taps(height(spark, sf), 4))))
for _m, _c in (("clamp", 0.0), ("mirror", 0.0), ("constant", 0.25)):
    query(f"stn01_gaussian_blur_{_m}", _separable_sql(_gaussian_sql("64", _m), _gaussian_sql(_H, _m), constant=_c))(lambda spark, sf, m=_m, c=_c: samples(stencil.gaussian_blur(plane(spark, sf), 1.5, 64, height(spark, sf), m, "propagate", c)))

_HORN = """WITH h AS (SELECT c.y, c.x, c.v,
  coalesce(nw.v, c.v) AS nw, coalesce(n.v, c.v) AS n, coalesce(ne.v, c.v) AS ne, coalesce(w.v, c.v) AS w, coalesce(e_.v, c.v) AS ea, coalesce(sw.v, c.v) AS sw, coalesce(s.v, c.v) AS s, coalesce(se.v, c.v) AS se
  FROM p c LEFT JOIN p nw ON nw.y = c.y - 1 AND nw.x = c.x - 1 LEFT JOIN p n ON n.y = c.y - 1 AND n.x = c.x LEFT JOIN p ne ON ne.y = c.y - 1 AND ne.x = c.x + 1
  LEFT JOIN p w ON w.y = c.y AND w.x = c.x - 1 LEFT JOIN p e_ ON e_.y = c.y AND e_.x = c.x + 1
  LEFT JOIN p sw ON sw.y = c.y + 1 AND sw.x = c.x - 1 LEFT JOIN p s ON s.y = c.y + 1 AND s.x = c.x LEFT JOIN p se ON se.y = c.y + 1 AND se.x = c.x + 1),
  g AS (SELECT y, x, v, ((ne + 2 * ea + se) - (nw + 2 * w + sw)) / 8 AS de, -((sw + 2 * s + se) - (nw + 2 * n + ne)) / 8 AS dn FROM h) """
query("stn04_slope", _HORN + f"SELECT y, x, {R('degrees(atan(sqrt(de * de + dn * dn)))')} AS v FROM g")(lambda spark, sf: samples(stencil.gradient(plane(spark, sf)).withColumn("v", stencil.slope())))
query("stn05_aspect", _HORN + f"SELECT y, x, {R('(degrees(atan2(-de, -dn)) + 360) % 360')} AS v FROM g")(lambda spark, sf: samples(stencil.gradient(plane(spark, sf)).withColumn("v", stencil.aspect())))
query("stn06_hillshade", _HORN + f"SELECT y, x, {R('greatest(0, least(255, 255 * (-de * cos(radians(45)) * sin(radians(315)) - dn * cos(radians(45)) * cos(radians(315)) + sin(radians(45))) / sqrt(de * de + dn * dn + 1)))')} AS v FROM g")(
    lambda spark, sf: samples(stencil.gradient(plane(spark, sf)).withColumn("v", stencil.hillshade()))
)
query("stn07_edge_nodata", _HORN + f"SELECT y, x, CASE WHEN y BETWEEN 1 AND (SELECT h - 2 FROM z) AND x BETWEEN 1 AND 62 THEN {R('sqrt(de * de + dn * dn) * 100')} END AS v FROM g")(
    lambda spark, sf: samples(stencil.gradient(plane(spark, sf), edge="nodata").withColumn("v", stencil.slope("percent")))
)

for _m, _sql in (("linear", "q"), ("sqrt", "sqrt(q)"), ("log", "ln(1 + 999 * q) / ln(1000)"), ("asinh", "asinh(10 * q) / asinh(10)")):
    query(f"fn08_scale_{_m}", f"WITH s AS (SELECT y, x, greatest(0, least(1, (v + 0.2) / 0.4)) AS q FROM p) SELECT y, x, {R(_sql)} AS v FROM s")(lambda spark, sf, m=_m: samples(plane(spark, sf).withColumn("v", scalar.display_scale((F.col("v") + 0.2) / 0.4, m))))
_BYTE = "greatest(0, least(255, floor((v + 0.2) / 0.4 * 255 + 0.5)))::INT"
query("fn12_to_bytes", f"SELECT y, x, {_BYTE} AS v FROM p")(lambda spark, sf: plane(spark, sf).select("y", "x", scalar.to_byte(F.col("v"), -0.2, 0.2).alias("v")))
query("fn13_window", "SELECT y, x, greatest(0, least(255, floor((v - -0.05) / (0.15 - -0.05) * 255 + 0.5)))::INT AS v FROM p")(lambda spark, sf: plane(spark, sf).select("y", "x", scalar.window_level(F.col("v"), 0.05, 0.2).alias("v")))
query("fn14_lut", f"SELECT y, x, ((255 - {_BYTE}) * 7) % 256 AS v FROM p")(lambda spark, sf: plane(spark, sf).select("y", "x", scalar.lookup(scalar.to_byte(F.col("v"), -0.2, 0.2), [(255 - i) * 7 % 256 for i in range(256)]).alias("v")))
query("fn10_render_grayscale", f"SELECT y, x, {_BYTE} AS r, {_BYTE} AS g, {_BYTE} AS b, 255 AS a FROM p")(lambda spark, sf: image.render(plane(spark, sf), -0.2, 0.2))
# Positions and colours of the palette's stops.
_VIRIDIS = "(0.00, 68, 1, 84), (0.13, 71, 44, 122), (0.25, 59, 82, 139), (0.38, 44, 113, 142), (0.50, 33, 145, 140), (0.63, 39, 173, 129), (0.75, 94, 201, 98), (0.88, 170, 220, 50), (1.00, 253, 231, 37)"
_BETWEEN = ", ".join(f"floor({c} + (t - pos) / (pos2 - pos) * ({c}2 - {c}) + 0.5)::INT AS {c}" for c in "rgb")
query(
    "fn09_palette_viridis",
    f"""WITH s(pos, r, g, b) AS (VALUES {_VIRIDIS}), w AS (SELECT pos::DOUBLE AS pos, r, g, b, lead(pos::DOUBLE) OVER q AS pos2, lead(r) OVER q AS r2, lead(g) OVER q AS g2, lead(b) OVER q AS b2 FROM s WINDOW q AS (ORDER BY pos)),
    k AS (SELECT i, {_BETWEEN} FROM (SELECT i, i / 255.0::DOUBLE AS t FROM (SELECT unnest(range(256)) AS i)) JOIN w ON (t > pos OR pos = 0) AND t <= pos2),
    u AS (SELECT y, x, {_BYTE} AS i FROM p) SELECT y, x, r, g, b, 255 AS a FROM u JOIN k USING (i)""",
)(lambda spark, sf: image.render(plane(spark, sf), -0.2, 0.2, "linear", "viridis"))
query(
    "stn09_relief",
    f"""WITH d AS (SELECT c.y, c.x, c.v, ((coalesce(e_.v, c.v) - coalesce(w.v, c.v)) / 0.4) * 2 AS dx, ((coalesce(s.v, c.v) - coalesce(n.v, c.v)) / 0.4) * 2 AS dy FROM p c
      LEFT JOIN p w ON w.y = c.y AND w.x = c.x - 1 LEFT JOIN p e_ ON e_.y = c.y AND e_.x = c.x + 1 LEFT JOIN p n ON n.y = c.y - 1 AND n.x = c.x LEFT JOIN p s ON s.y = c.y + 1 AND s.x = c.x),
    f AS (SELECT y, x, {_BYTE} AS i, greatest(0, (-dx * sin(radians(315)) * cos(radians(45)) + dy * cos(radians(315)) * cos(radians(45)) + sin(radians(45))) / sqrt(dx * dx + dy * dy + 1)) AS sh FROM d)
    SELECT y, x, floor(i * (0.5 + 0.5 * (0.35 + 0.65 * sh)) + 0.5)::INT AS r FROM f""",
)(lambda spark, sf: image.relief(image.render(p := plane(spark, sf), -0.2, 0.2), p, -0.2, 0.2).select("y", "x", "r"))

_CC = """WITH RECURSIVE m AS (SELECT y, x FROM p WHERE v > 0.2), j(a, b) AS (
  SELECT y * 64 + x, y * 64 + x FROM m UNION SELECT j.a, n.y * 64 + n.x FROM j JOIN m n ON abs(n.y - j.b // 64) <= 1 AND abs(n.x - j.b % 64) <= 1 {only}),
  l AS (SELECT a, min(b) AS root FROM j GROUP BY a), q AS (SELECT a // 64 AS y, a % 64 AS x, dense_rank() OVER (ORDER BY root) AS label FROM l) """


def _mask(spark, sf):
    return project.threshold(plane(spark, sf), "greater-than", 0.2)


def _cc(only: str, tail: str) -> str:
    return _WITH.replace("WITH e", "WITH RECURSIVE e", 1) + ", " + _CC.format(only=only)[len("WITH RECURSIVE ") :] + tail


for _n, _only in ((8, ""), (4, "AND abs(n.y - j.b // 64) + abs(n.x - j.b % 64) <= 1")):
    query(f"agg09_components_{_n}")(lambda spark, sf, n=_n: components.label(_mask(spark, sf), 64, n).select("y", "x", F.col("label").cast("long").alias("label")))
    ORACLES[f"agg09_components_{_n}"] = _cc(_only, "SELECT y::INT AS y, x::INT AS x, label FROM q")
query("agg10_object_table")(
    lambda spark, sf: reduce.moments(components.label(_mask(spark, sf), 64, 8), ["label"]).select("label", "pixels", "box_x", "box_y", "box_width", "box_height", *[r(c).alias(c) for c in ("centroid_x", "centroid_y", "diameter", "major", "minor", "area")])
)
ORACLES["agg10_object_table"] = _cc(
    "",
    f""", s AS (SELECT label::INT AS label, count(*) AS pixels, min(x)::INT AS box_x, min(y)::INT AS box_y, (max(x) - min(x) + 1)::INT AS box_width, (max(y) - min(y) + 1)::INT AS box_height, avg(x + 0.5) AS cx, avg(y + 0.5) AS cy, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM q GROUP BY label)
    SELECT label, pixels, box_x, box_y, box_width, box_height, {R('cx')} AS centroid_x, {R('cy')} AS centroid_y, {R('2 * sqrt(pixels / pi())')} AS diameter,
    {R('4 * sqrt(greatest(0, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)))')} AS major, {R('4 * sqrt(greatest(0, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy)))')} AS minor, {R('pixels::DOUBLE')} AS area FROM s""",
)

for _code, _x, _y in ((2, "63 - x", "y"), (3, "63 - x", "(SELECT h FROM z) - 1 - y"), (4, "x", "(SELECT h FROM z) - 1 - y"), (5, "y", "x"), (6, "(SELECT h FROM z) - 1 - y", "x"), (7, "(SELECT h FROM z) - 1 - y", "63 - x"), (8, "y", "63 - x")):
    query(f"img03_orient_{_code}", f"SELECT {_y} AS y, {_x} AS x, {R('v')} AS v FROM p")(lambda spark, sf, c=_code: samples(image.Image(plane(spark, sf), 64, height(spark, sf)).auto_orient(c).df))
query("img06_rotate_90", f"SELECT x AS y, (SELECT h FROM z) - 1 - y AS x, {R('v')} AS v FROM p")(lambda spark, sf: samples(image.Image(plane(spark, sf), 64, height(spark, sf)).rotate(90).df))


@query("stn13_rotate_30")
def _(spark, sf):
    return samples(image.rotate(plane(spark, sf), 30, 64, height(spark, sf))[0])


_SCALE = f"least(32 / 64.0::DOUBLE, 150 / ({_H})::DOUBLE)"
query(
    "img02_resize_inside",
    _separable_sql(_linear_sql("64", f"greatest(1, floor(64 * {_SCALE} + 0.5))"), _linear_sql(_H, f"greatest(1, floor({_H} * {_SCALE} + 0.5))"), f"(SELECT y, x, {_BYTE}::DOUBLE AS v FROM p)", value="greatest(0, least(255, floor(sum(v * w) + 0.5)))::INT"),
)(lambda spark, sf: image.Image(plane(spark, sf).select("y", "x", scalar.to_byte(F.col("v"), -0.2, 0.2).alias("v")), 64, height(spark, sf)).resize(32, 150, "inside", "bilinear").df.select("y", "x", "v"))

def _source(spark, sf) -> geo.Grid:
    return geo.Grid("EPSG:32616", 64, height(spark, sf), (10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0))


def _target(spark, sf) -> geo.Grid:
    """Over the source's edge by some lines."""
    return geo.Grid("EPSG:32616", 50, height(spark, sf), (12.0, 0.0, 1055.0, 0.0, -12.0, 4940.0))


_AT = f"WITH g AS (SELECT x.x::INT AS x, y.y::INT AS y, ((x.x + 0.5) * 12.0::DOUBLE + 1055 - 1000) / 10 - 0.5 AS sx, (5000 - (4940 - (y.y + 0.5) * 12.0::DOUBLE)) / 10 - 0.5 AS sy FROM (SELECT unnest(range(50)) AS x) x, (SELECT unnest(range({_H})) AS y) y) "
query("geo01_reproject_nearest", _AT + f"SELECT g.y, g.x, {R('p.v')} AS v FROM g LEFT JOIN p ON p.x = floor(sx + 0.5) AND p.y = floor(sy + 0.5)")(lambda spark, sf: samples(geo.read_at(plane(spark, sf), _source(spark, sf), _target(spark, sf))))
query(
    "geo01_reproject_bilinear",
    _AT + ", k AS (SELECT g.*, floor(sx) + i AS px, floor(sy) + j AS py, (CASE i WHEN 0 THEN floor(sx) + 1 - sx ELSE sx - floor(sx) END) * (CASE j WHEN 0 THEN floor(sy) + 1 - sy ELSE sy - floor(sy) END) AS w FROM g, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) "
    f"SELECT k.y, k.x, CASE WHEN sum(w) FILTER (p.v IS NOT NULL) >= 0.5 - 1e-12 THEN {R('sum(p.v * w) / (sum(w) FILTER (p.v IS NOT NULL))')} END AS v FROM k LEFT JOIN p ON p.x = px AND p.y = py GROUP BY k.y, k.x",
)(lambda spark, sf: samples(geo.read_at(plane(spark, sf), _source(spark, sf), _target(spark, sf), "bilinear")))
query("geo01_reproject_transform", "SELECT y, x, round(v, 6) + 0 AS v FROM p")(lambda spark, sf: samples(geo.read_at(plane(spark, sf), g := _source(spark, sf), geo.Grid("test:shifted", 64, g.height, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)), "nearest", lambda x, y: (1000 + 10 * x, 5000 - 10 * y))))

GRAPH = {
    "schemaVersion": 1,
    "inputs": [{"name": "plane"}],
    "nodes": [
        {"id": "cut", "operation": {"id": "analysis.crop"}, "inputs": [{"port": "dataset", "source": "input:plane"}], "parameters": {"x": 4, "y": 20, "width": 40, "height": 100}},
        {"id": "mask", "operation": {"id": "analysis.threshold"}, "inputs": [{"port": "dataset", "source": "node:cut"}], "parameters": {"mode": "inside", "low": -0.1, "high": 0.1}},
        {"id": "count", "operation": {"id": "analysis.statistics"}, "inputs": [{"port": "dataset", "source": "node:mask"}]},
    ],
    "outputs": [{"name": "count", "source": "node:count"}],
}
query("ext12_graph", f"SELECT {STATS_SQL} FROM (SELECT CASE WHEN v BETWEEN -0.1 AND 0.1 THEN 1 ELSE 0 END AS v FROM p WHERE x BETWEEN 4 AND 43 AND y BETWEEN 20 AND 119)")(
    lambda spark, sf: Graph(GRAPH).build({"plane": plane(spark, sf)})["count"].select(*STATS[:3], *[r(F.col(c).cast("double")).alias(c) for c in STATS[3:]])
)
