import gzip
import json
import struct

import numpy as np
import pytest
from quadrille.sources import stores


@pytest.mark.parametrize("version", [2, 3])
def test_zarr(spark, tmp_path, version):
    a = np.arange(35, dtype="<i2").reshape(5, 7)
    padded = np.zeros((6, 8), "<i2")
    padded[:5, :7] = a
    if version == 2:
        (tmp_path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 7], "chunks": [3, 4], "dtype": "<i2", "order": "C", "compressor": {"id": "gzip"}, "filters": None, "fill_value": -1}))
    else:
        (tmp_path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [5, 7], "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}], "fill_value": -1}))
    for i in range(2):
        for j in range(2):
            if (i, j) == (1, 1):
                continue  # a missing chunk
            p = tmp_path / (f"{i}.{j}" if version == 2 else f"c/{i}/{j}")
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(gzip.compress(padded[3 * i : 3 * i + 3, 4 * j : 4 * j + 4].tobytes()))
    want = a.astype(float)
    want[3:, 4:] = -1
    got = np.zeros((5, 7))
    rows = stores.read_zarr(spark, str(tmp_path)).collect()
    for r in rows:
        got[r.i0, r.i1] = r.v
    assert len(rows) == 35 and (got == want).all()
    part = stores.read_zarr(spark, str(tmp_path), {0: (1, 3), 1: (2, 3)}).collect()
    assert sorted((r.i0, r.i1, r.v) for r in part) == [(1, 2, 9.0), (2, 2, 16.0)]


def test_netcdf(spark, tmp_path):
    name = lambda s: struct.pack(">I", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    a = np.arange(6).reshape(2, 3)
    fill = name("_FillValue") + struct.pack(">II", 3, 1) + struct.pack(">h", 4) + b"\0\0"
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 2) + name("y") + struct.pack(">I", 2) + name("x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    var = name("v") + struct.pack(">III", 2, 0, 1) + struct.pack(">II", 12, 1) + fill + struct.pack(">II", 3, 12)
    head += struct.pack(">II", 11, 1) + var
    (tmp_path / "a.nc").write_bytes(head + struct.pack(">I", len(head) + 4) + a.astype(">i2").tobytes())
    rows = stores.read_netcdf(spark, str(tmp_path), "v").orderBy("y").collect()
    assert [r["values"] for r in rows] == [[0, 1, 2], [3, None, 5]]
    with pytest.raises(ValueError):
        stores.NetCdf(b"CDF\x05")


def test_world_file():
    assert stores.world_file("10\n0\n0\n-10\n500\n900\n") == (10, 0, 500, 0, -10, 900)
