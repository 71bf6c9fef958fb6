import math

import __spark_entry__


def test_rotate_takes_every_line(spark, tmp_path):
    lines = [[float((7 * y + 3 * x) % 11) for x in range(64)] for y in range(90)]
    spark.createDataFrame([(y, v) for y, v in enumerate(lines)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.y, r.x): r.v for r in __spark_entry__.queries()["stn13_rotate_30"](spark, str(tmp_path)).collect()}
    cos, sin = math.cos(math.pi / 6), math.sin(math.pi / 6)
    w, h = math.ceil(64 * cos + 90 * sin), math.ceil(64 * sin + 90 * cos)
    assert len(got) == w * h
    at = lambda y, x: lines[y][x] if 0 <= y < 90 and 0 <= x < 64 else 0.0
    for (y, x), v in got.items():
        dx, dy = x + 0.5 - w / 2, y + 0.5 - h / 2
        sx, sy = dx * cos + dy * sin + 31.5, -dx * sin + dy * cos + 44.5
        i, j = math.floor(sx), math.floor(sy)
        want = sum(at(j + b, i + a) * abs(1 - a - (sx - i)) * abs(1 - b - (sy - j)) for a in (0, 1) for b in (0, 1))
        assert abs(v - want) < 1e-4
