import math

import pytest
from pyspark.sql import functions as F
from quadrille.functions import bandmath
from quadrille.operators import image, stencil


def test_absent_rows_are_as_null_ones(spark):
    rows = [(y, x, float(y * 10 + x * x)) for y in range(5) for x in range(5)]
    null = spark.createDataFrame([(y, x, None if (y, x) == (2, 2) else v) for y, x, v in rows], "y int, x int, v double")
    absent = spark.createDataFrame([r for r in rows if r[:2] != (2, 2)], "y int, x int, v double")
    a, b = ({(r.y, r.x): (r.de, r.dn) for r in stencil.gradient(df).collect()} for df in (null, absent))
    assert a.pop((2, 2)) == (None, None) and a == b


def test_relief_keeps_colours_beside_nodata(spark):
    rows = [(y, x, None if (y, x) == (1, 1) else 0.1 * x + 0.3 * y) for y in range(4) for x in range(4)]
    plane = spark.createDataFrame(rows, "y int, x int, v double")
    got = {(r.y, r.x): (r.r, r.a) for r in image.relief(image.render(plane, 0, 1.2), plane, 0, 1.2).collect()}
    v = {(y, x): v for y, x, v in rows}
    for (y, x), c in v.items():
        near = [v.get(k, c) for k in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x))]
        factor = 1.0
        if None not in near:
            dx, dy = (near[0] - near[1]) / 1.2 * 2, (near[2] - near[3]) / 1.2 * 2
            light = math.sqrt(0.5) * math.sqrt(0.5)
            shade = max(0, (dx * light + dy * light + math.sqrt(0.5)) / math.hypot(dx, dy, 1))
            factor = 0.5 + 0.5 * (0.35 + 0.65 * shade)
        want = 0 if c is None else math.floor(math.floor(c / 1.2 * 255 + 0.5) * factor + 0.5)
        assert got[y, x] == (want, 0 if c is None else 255)


def test_palettes_stand_at_their_stops():
    plasma = image.palette("plasma")
    assert plasma[0] == (13, 8, 135) and plasma[255] == (240, 249, 33)
    at = 64 / 255
    amount = (at - 0.25) / 0.13
    assert plasma[64] == tuple(math.floor(a + amount * (b - a) + 0.5) for a, b in zip((126, 3, 168), (168, 34, 150)))


def test_band_math_leaves_the_reals(spark):
    df = spark.createDataFrame([(-1.0, 1000.0)], "a double, b double")
    names = {n: F.col(n) for n in "ab"}
    for text in ("pow(a, 0.5)", "exp(b)", "min(exp(b), 1)", "1e308 * b", "log(a)"):
        assert df.select(bandmath.compile_expression(text, names)).first()[0] is None, text
    with pytest.raises(ValueError):
        bandmath.compile_expression("min(a, b, 1)", names)
