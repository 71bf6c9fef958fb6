import math

import pytest
from quadrille.operators import image


def brute(pixels, degrees, width, height, background):
    a = math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    w, h = math.ceil(abs(width * cos) + abs(height * sin) - 1e-9), math.ceil(abs(width * sin) + abs(height * cos) - 1e-9)
    at = lambda y, x: background if pixels.get((y, x)) is None else pixels[y, x]
    out = {}
    for y in range(h):
        for x in range(w):
            dx, dy = x + 0.5 - w / 2, y + 0.5 - h / 2
            sx, sy = dx * cos + dy * sin + width / 2 - 0.5, -dx * sin + dy * cos + height / 2 - 0.5
            i, j = math.floor(sx), math.floor(sy)
            out[y, x] = sum(at(j + b, i + c) * abs(1 - c - (sx - i)) * abs(1 - b - (sy - j)) for c in (0, 1) for b in (0, 1))
    return out, w, h


@pytest.mark.parametrize("width, height", [(5, 270), (270, 4), (17, 23)])
@pytest.mark.parametrize("degrees", [30, 90, 200, -1e-7])
def test_every_pixel_of_the_canvas(spark, width, height, degrees):
    pixels = {(y, x): None if (y * 31 + x) % 13 == 0 else float((7 * y + 3 * x) % 11 + 1) for y in range(height) for x in range(width) if (y + x) % 17}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in pixels.items()] or [(0, 0, None)], "y int, x int, v double")
    out, w, h = image.rotate(df, degrees, width, height, 2.5)
    want, *size = brute(pixels, degrees, width, height, 2.5)
    got = out.collect()
    assert [w, h] == size and len(got) == len(want) == w * h
    assert {(r.y, r.x): r.v for r in got} == pytest.approx(want, abs=1e-9)


def test_an_empty_plane_and_samples_outside_of_it(spark):
    out, w, h = image.rotate(spark.createDataFrame([], "y int, x int, v double"), 30, 64, 0)
    assert sorted((r.y, r.x, r.v) for r in out.collect()) == [(y, x, 0.0) for y in range(h) for x in range(w)] and w * h > 0
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 9.0), (-1, 0, 9.0)], "y int, x int, v double")
    assert sorted((r.x, r.v) for r in image.rotate(df, 0, 2, 1)[0].collect()) == [(0, 1.0), (1, 2.0)]


def shuffled(spark, df):
    """Rows written to shuffles for a result."""
    context = spark.sparkContext
    context.setJobGroup(name := f"rotation-{id(df)}", "")
    df.write.format("noop").mode("overwrite").save()
    context._jsc.clearJobGroup()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds})


def test_background_is_not_shuffled(spark):
    rows = []
    for height in (300, 1200):
        plane = spark.range(height * 8).selectExpr("CAST(id DIV 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x", "CAST(1 AS DOUBLE) AS v")
        out, w, h = image.rotate(plane, 30, 8, height)
        rows.append((w * h, shuffled(spark, out)))
    assert rows[1][0] > 12 * rows[0][0], rows
    assert 0 < rows[1][1] < 5 * rows[0][1], rows
