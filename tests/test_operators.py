import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from quadrille.descriptor import Axis, Coordinates, Descriptor
from quadrille.functions import bandmath, scalar
from quadrille.operators import components, geo, image, project, reduce, roi, stencil
from quadrille.plans.catalog import GRAPH
from quadrille.plans.graph import Graph, Operation, built_in
from quadrille.sources import codecs, files
from quadrille.streaming import ingest


def grid(spark, width, height, f, parts=2):
    rows = [(y, x, None if (v := f(x, y)) is None else float(v)) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "y int, x int, v double").repartition(parts)


def values(df, width):
    return [r.v for r in sorted(df.collect(), key=lambda r: r.y * width + r.x)]


def fx01(spark, parts=2):
    return grid(spark, 5, 4, lambda x, y: None if y * 10 + x == 22 else y * 10 + x, parts)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_rectangle_statistics(spark, parts):
    s = reduce.statistics(fx01(spark, parts).filter(roi.rectangle(1, 1, 3, 2))).first()
    assert (s.n, s.finite, s.invalid, s.minimum, s.maximum, s.mean) == (6, 5, 1, 11, 23, 16)
    assert s.deviation == pytest.approx(math.sqrt(24.8))
    found = {r.p: r.value for r in reduce.percentiles(fx01(spark).filter(roi.rectangle(1, 1, 3, 2)), [0, 100]).collect()}
    assert found == {0: 11, 100: 23}


def test_polygon(spark):
    s = reduce.statistics(roi.within_polygon(fx01(spark), [(0, 0), (5, 0), (5, 1.75), (2.75, 1.75), (2.75, 4), (0, 4)], 4)).first()
    assert (s.n, s.finite) == (16, 15) and s.mean == pytest.approx(13.6)
    square = roi.polygon_spans([(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5)], 4)
    assert sorted({(y, x) for y, a, b in square for x in range(a, b + 1)}) == [(y, x) for y in range(3) for x in range(3)]


def test_histogram(spark):
    auto = [r.n for r in reduce.histogram(fx01(spark).filter(roi.rectangle(1, 1, 3, 2)), 4).orderBy("bin").collect()]
    assert auto == [0, 3, 0, 0, 2, 0]
    given = [r.n for r in reduce.histogram(fx01(spark), 2, 10, 20).orderBy("bin").collect()]
    assert given == [5, 5, 1, 8]
    flat = reduce.histogram(grid(spark, 2, 2, lambda x, y: 3), 2).orderBy("bin").collect()
    assert [r.n for r in flat] == [0, 0, 4, 0] and flat[1].low == 2.5


def test_profile(spark):
    plane = fx01(spark)
    line = roi.profile(plane, roi.line_samples([(0.5, 0.5), (4.5, 0.5)], 2, 2, 3), "nearest").orderBy("k").collect()
    assert [r.distance for r in line] == [0, 2, 4, 6, 8] and [r.v for r in line] == [0, 1, 2, 3, 4]
    assert [r.v for r in roi.profile(plane, roi.line_samples([(1.0, 1.0), (3.0, 1.0)], 1), "bilinear").orderBy("k").collect()] == [5.5, 6.5, 7.5]
    assert [r.v for r in roi.profile(plane, [(0, 0.0, 9.0, 0.5)]).collect()] == [None]
    nine = grid(spark, 3, 3, lambda x, y: x + 3 * y)
    assert [r.v for r in roi.profile(nine, [(k, 0.0, float(k), float(k)) for k in range(3)], "nearest", 0.0).orderBy("k").collect()] == [0, 4, 8]
    assert roi.profile(nine, [(0, 0.0, 0.5, 0.5)], "bilinear", 0.0, 0.5).first().v == 2


def test_resample(spark):
    plane = grid(spark, 4, 4, lambda x, y: y * 10 + x)
    assert values(stencil.resample(plane, (4, 4), (2, 2)), 2) == [11, 13, 31, 33]
    assert values(stencil.resample(plane, (4, 4), (2, 2), "bilinear"), 2) == [5.5, 7.5, 25.5, 27.5]
    hole = plane.withColumn("v", F.when(~((F.col("x") == 0) & (F.col("y") == 0)), F.col("v")))
    assert values(stencil.resample(hole, (4, 4), (2, 2), "bilinear"), 2)[0] is None
    assert values(stencil.resample(hole, (4, 4), (2, 2), "bilinear", "ignore"), 2)[0] is not None


@pytest.mark.parametrize("mode", ["clamp", "mirror", "constant"])
def test_blur(spark, mode):
    a = np.random.default_rng(1).normal(size=(6, 9))
    w = np.array(stencil.gaussian(0.8))
    r = len(w) // 2
    want = np.zeros_like(a)
    for y in range(6):
        for x in range(9):
            for i in range(-r, r + 1):
                for j in range(-r, r + 1):
                    yy, xx = stencil.border(y + i, 6, mode), stencil.border(x + j, 9, mode)
                    want[y, x] += w[i + r] * w[j + r] * (2.0 if yy is None or xx is None else a[yy, xx])
    got = values(stencil.gaussian_blur(grid(spark, 9, 6, lambda x, y: a[y, x]), 0.8, 9, 6, mode, "propagate", 2.0 if mode == "constant" else 0.0), 9)
    assert got == pytest.approx(want.ravel().tolist())


def test_terrain(spark):
    g = stencil.gradient(grid(spark, 7, 7, lambda x, y: x + 2 * y), rows_north=True)
    r = g.select("y", "x", stencil.slope().alias("s"), stencil.aspect().alias("a"), stencil.hillshade(225, 45).alias("h")).filter("x = 3 AND y = 3").first()
    assert r.s == pytest.approx(65.905157, abs=1e-5) and r.a == pytest.approx(206.565051, abs=1e-5) and r.h == pytest.approx(229.767130, abs=1e-4)
    hole = stencil.gradient(grid(spark, 5, 5, lambda x, y: None if x == y == 2 else x)).filter("de IS NULL").count()
    assert hole == 1
    assert stencil.gradient(grid(spark, 3, 3, lambda x, y: 1)).withColumn("a", stencil.aspect()).filter("a IS NOT NULL").count() == 0


def test_components_and_objects(spark):
    path = {(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 4)}
    mask = grid(spark, 6, 6, lambda x, y: int((x, y) in path))
    assert components.label(mask, 6, 4).select("label").distinct().count() == 2
    assert components.label(mask, 6, 8).select("label").distinct().count() == 1
    first = reduce.moments(components.label(mask, 6, 4), ["label"]).orderBy("label").first()
    assert (first.label, first.pixels, first.box_width, first.box_height, first.centroid_x, first.centroid_y) == (1, 6, 2, 3, 2, 2.5)
    snake = {(x, y) for y in range(0, 9, 2) for x in range(9)} | {(8 if y % 4 == 1 else 0, y) for y in range(1, 9, 2)}
    assert components.label(grid(spark, 9, 9, lambda x, y: int((x, y) in snake)), 9, 4).select("label").distinct().count() == 1
    assert components.label(grid(spark, 3, 3, lambda x, y: None), 3).count() == 0


def test_spectral(spark):
    base, rows = [0, 1, 2, 10, 11, 12], []
    for c in range(3):
        rows += [(0, p, c, 450.0 + 100 * c, float(v + 100 * c)) for p, v in enumerate(base)]
    cube = spark.createDataFrame(rows, "y int, x int, channel int, centre double, v double")
    assert [r.v for r in reduce.integrate(cube, ["y", "x"], 440, 660).orderBy("x").collect()][:3] == [20000, 20200, 20400]
    ratio = reduce.bands(cube, ["y", "x"], {"a": 2, "b": 0}).select("x", scalar.ratio(F.col("a"), F.col("b")).alias("v")).orderBy("x").collect()
    assert [r.v for r in ratio][:3] == [None, 201, 101]
    assert reduce.nearest_channel(cube.select("channel", "centre").distinct(), 500).first().channel == 0


def test_projection(spark):
    cube = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 5.0), (0, 0, 2, 7.0), (0, 1, 0, None)], "y int, x int, z int, v double")
    assert values(reduce.project(cube, ["y", "x"], "mean"), 2) == [6, None]
    assert values(reduce.project(cube, ["y", "x"], "max", "propagate"), 2) == [None, None]


def test_band_math(spark):
    df = spark.createDataFrame([(1.0, 29.0), (2.0, None), (0.0, 0.0)], "red double, nir double")
    names = {"red": F.col("red"), "nir": F.col("nir")}
    run = lambda t, **k: [r.v for r in df.select(bandmath.compile_expression(t, names, **k).alias("v")).collect()]
    assert run("max(red * 2, nir) + 1") == [30, None, 1]
    assert run("-(1 - 2) * 3 / red") == [3, 1.5, None] and run("3 / red", divide_by_zero="zero")[2] == 0
    assert run("log(-1)") == [None] * 3 and run("2 - 3 - 4")[0] == -5
    for bad in ("red +", "red nir", "foo(1)", "abs(1, 2)", "green", "1 $ 2", "min(1)"):
        with pytest.raises(ValueError):
            bandmath.compile_expression(bad, names)


def test_geo(spark):
    src = geo.Grid("EPSG:32616", 3, 3, (1, 0, 0, 0, 1, 0), "point")
    plane = grid(spark, 3, 3, lambda x, y: x + 10 * y)
    half = geo.Grid("EPSG:32616", 2, 2, (1, 0, 0.5, 0, 1, 0.5), "point")
    assert values(geo.read_at(plane, src, half, "bilinear"), 2) == [5.5, 6.5, 15.5, 16.5]
    assert geo.invert((1, 0, 0, 2, 0, 0)) is None and geo.apply(geo.invert((2, 0, 5, 0, -3, 7)), 9, 1) == pytest.approx((2, 2))
    assert geo.relation(src, half) == "same-crs-different-grid" and not geo.aligned(src, half)
    assert geo.intersection((0, 0, 1, 1), (1, 0, 2, 1)) == (1, 0, 1, 1) and geo.intersection((0, 0, 1, 1), (2, 0, 3, 1)) is None
    north = geo.propose_grid("x", (0, 0, 100, 50), resolution=10)
    assert (north.width, north.height) == (10, 5) and geo.region(north, (11, 11, 29, 29)) == (1, 2, 2, 2) and north.bounds() == (0, 0, 100, 50)
    assert geo.crs_kind('PROJCS["a"]') == "PROJCS" and geo.crs_kind("?") is None
    assert geo.transform_bounds((0, 0, 1, 2), lambda x, y: (y, x)) == (0, 0, 2, 1)
    with pytest.raises(ValueError):
        geo.read_at(plane, src, geo.Grid("other", 1, 1, (1, 0, 0, 0, 1, 0)))


def test_image(spark):
    img = image.Image(grid(spark, 3, 2, lambda x, y: y * 10 + x), 3, 2)
    assert values(img.rotate(90).df, 2) == [10, 0, 11, 1, 12, 2] and values(img.flip().df, 3)[:3] == [10, 11, 12] and values(img.flop().df, 3)[:3] == [2, 1, 0]
    back = img
    for _ in range(4):
        back = back.rotate(90)
    assert values(back.df, 3) == values(img.df, 3)
    assert values(img.resize(6, 4, "fill", "nearest").df, 6)[:6] == [0, 0, 1, 1, 2, 2]
    assert stencil.fit_size((400, 200), 100, 100, "inside") == (100, 50) and stencil.fit_size((400, 200), 100, 100, "outside") == (200, 100)
    assert values(image.rotate(img.df, 180, 3, 2)[0], 3) == pytest.approx([12, 11, 10, 2, 1, 0])
    assert image.palette("grayscale")[77] == (77, 77, 77) and len(image.palette("viridis")) == 256
    with pytest.raises(ValueError):
        img.crop(1, 1, 3, 3)


def test_descriptor():
    d = Descriptor((Axis("x", 4, coordinates=Coordinates("linear", 10, 2)), Axis("y", 4), Axis("energy", 3)))
    assert d.resampled(2, 2).axis("x").coordinates == Coordinates("linear", 11, 4)
    assert d.cropped(1, 0, 2, 2).axis("x").coordinates.origin == 12 and d.sliced(("energy", "x"), {"y": 1}).axes[0].id == "energy"
    c = Coordinates("lookup", values=(1.0, 2.0, 4.0))
    assert [c.pixel(c.physical(p)) for p in (0.5, 1.25, 2.9)] == pytest.approx([0.5, 1.25, 2.9])
    for bad in (lambda: d.cropped(3, 0, 2, 1), lambda: d.sliced(("x", "y"), {}), lambda: Coordinates("lookup", values=(1.0, 1.0)).pixel(1)):
        with pytest.raises(ValueError):
            bad()


def test_graph(spark):
    g = Graph(GRAPH)
    renamed = {**GRAPH, "nodes": [{**n, "id": n["id"] + "2", "inputs": [{**i, "source": i["source"] + ("2" if i["source"].startswith("node") else "")} for i in n["inputs"]]} for n in reversed(GRAPH["nodes"])], "outputs": [{"name": "count", "source": "node:count2"}]}
    assert Graph(renamed).hash() == g.hash() and g.order == ["cut", "mask", "count"]
    plane = grid(spark, 64, 130, lambda x, y: (x - y) / 100)
    assert "mean:double" in g.dry_run({"plane": plane})["count"] and g.build({"plane": plane})["count"].first().n == 4000
    loop = {"schemaVersion": 1, "inputs": [], "nodes": [{"id": "a", "operation": {"id": "analysis.statistics"}, "inputs": [{"port": "dataset", "source": "node:a"}]}], "outputs": []}
    for bad in (loop, {"schemaVersion": 2}, {**GRAPH, "outputs": [{"name": "o", "source": "node:none"}]}):
        with pytest.raises(ValueError):
            Graph(bad)
    registry = built_in()
    assert len(registry.ids()) == 11
    with pytest.raises(ValueError):
        registry.add(registry.get("analysis.crop"))
    registry.add(Operation("my.double", lambda i, p: i["dataset"].withColumn("v", F.col("v") * 2)))


@pytest.mark.parametrize("format,planes", [("npy", 2), ("pfm", 3), ("pgm", 1), ("ppm", 3), ("png", 1), ("png", 4), ("bmp", 3), ("tga", 3), ("tga", 1)])
def test_round_trip(format, planes):
    a = np.random.default_rng(0).integers(0, 256, (planes, 5, 7)).astype(float)
    assert (codecs.decode(codecs.encode(a, format), f"x.{format}") == a).all()


def test_decoders():
    a = np.arange(6).reshape(2, 3)
    assert (codecs.decode(b"ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n0 1 2\n3 4 5\n") == a).all()
    assert (codecs.decode(np.arange(9, dtype=">i2").tobytes(), "N00E000.hgt")[0, 2] == [6, 7, 8]).all()
    assert (codecs.decode(b"P2 # c\n3 2\n9\n0 1 2 3 4 5\n") == a).all()
    assert (codecs.decode(b"NRRD0004\ntype: short\ndimension: 2\nsizes: 3 2\nencoding: raw\nendian: little\n\n" + a.astype("<i2").tobytes()) == a).all()
    assert (codecs.decode(b"ObjectType = Image\nNDims = 2\nDimSize = 3 2\nElementType = MET_UCHAR\nElementDataFile = LOCAL\n" + a.astype("u1").tobytes()) == a).all()
    head = b"Gwyddion Simple Field 1.0\nXRes = 3\nYRes = 2\n"
    assert (codecs.decode(head + b"\0" * (4 - len(head) % 4) + a.astype("<f4").tobytes()) == a).all()
    card = lambda k, v: f"{k:8}= {v:>20}".ljust(80)
    fits = (card("SIMPLE", "T") + card("BITPIX", 16) + card("NAXIS", 2) + card("NAXIS1", 3) + card("NAXIS2", 2) + "END".ljust(80)).ljust(2880).encode()
    assert (codecs.decode(fits + a.astype(">i2").tobytes()) == a).all()
    assert (codecs.envi("ENVI\nsamples = 3\nlines = 2\nbands = 1\ndata type = 2\ninterleave = bsq\n", a.astype("<i2").tobytes())[0] == a).all()
    for bad in (b"\xff\xd8\xff", b"nothing"):
        with pytest.raises(ValueError):
            codecs.decode(bad)


def test_files_and_stream(spark, tmp_path):
    df = grid(spark, 4, 3, lambda x, y: y * 10 + x).withColumn("image", F.lit("a"))
    row = files.encode_planes(df, "pgm").first()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgm").write_bytes(row.content)
    lines = files.read_rasters(spark, f"{tmp_path}/in")
    assert values(project.samples(lines), 4) == values(df, 4)
    assert files.identities(spark, f"{tmp_path}/in").first().length == len(row.content)
    seen = []
    q = ingest.follow(spark, f"{tmp_path}/in", lambda batch, k: seen.append(batch.count()), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sum(seen) == 3


def test_pushdown(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("y"), F.col("embedding").alias("values"))
    plan = project.crop_lines(rows, 8, 10, 32, 100)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThanOrEqual(vec_id,10)" in plan and "slice(" in plan
