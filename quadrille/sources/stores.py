"""Chunked and sectioned stores: Zarr v2 and v3 directories (a task a chunk) and classic NetCDF files."""

from __future__ import annotations

import gzip
import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _inflate(data: bytes, codec: str) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {"gzip": gzip.decompress, "zlib": zlib.decompress}[codec](data)


def _small_text(spark: SparkSession, path: str) -> str | None:
    """A metadata file by Hadoop's file systems (Spark's readers skip names that begin with a dot)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def zarr_metadata(documents: dict[str, str]) -> dict:
    """Shape, chunks, dtype, order, codecs, fill value and key layout of an array, from ``.zarray`` or ``zarr.json``."""
    if "zarr.json" in documents:
        m = json.loads(documents["zarr.json"])
        if m.get("node_type") != "array":
            raise ValueError("no Zarr array")
        codecs, order, names = [], "<", [c["name"] for c in m["codecs"]]
        for c in m["codecs"]:
            if c["name"] == "bytes":
                order = ">" if c.get("configuration", {}).get("endian") == "big" else "<"
            elif c["name"] in ("gzip", "zstd", "zlib"):
                codecs.append(c["name"])
            elif c["name"] != "crc32c":
                raise ValueError(f"Zarr codec {c['name']} is not supported")
        kind = {"bool": "?", "float32": "f4", "float64": "f8", "float16": "f2", **{f"{s}int{b}": f"{t}{b // 8}" for s, t in (("", "i"), ("u", "u")) for b in (8, 16, 32, 64)}}[m["data_type"]]
        encoding = m.get("chunk_key_encoding", {"name": "default"})
        separator = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
        return {"shape": m["shape"], "chunks": m["chunk_grid"]["configuration"]["chunk_shape"], "dtype": order + kind, "order": "C", "codecs": codecs, "tail": 4 * (names[-1] == "crc32c"), "fill": m.get("fill_value"), "prefix": "c" + separator if encoding["name"] == "default" else "", "separator": separator}
    m = json.loads(documents[".zarray"])
    if m.get("filters"):
        raise ValueError("Zarr filters are not supported")
    codec = (m["compressor"] or {}).get("id")
    if codec not in (None, "gzip", "zlib", "zstd"):
        raise ValueError(f"Zarr codec {codec} is not supported")
    return {"shape": m["shape"], "chunks": m["chunks"], "dtype": m["dtype"], "order": m["order"], "codecs": [codec] if codec else [], "tail": 0, "fill": m.get("fill_value"), "prefix": "", "separator": m.get("dimension_separator", ".")}


def read_zarr(spark: SparkSession, path: str, region: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Sample form of an array: ``i0 .. ik, v``. ``region``: dimension to (start, stop); only chunks that meet it are read.

    A chunk without a file gives its fill value.
    """
    base = path.rstrip("/")
    m = zarr_metadata({n: t for n in (".zarray", "zarr.json") if (t := _small_text(spark, f"{base}/{n}")) is not None})
    shape, chunks = m["shape"], m["chunks"]
    limits = [(region or {}).get(k, (0, n)) for k, n in enumerate(shape)]
    names = [f"i{k}" for k in range(len(shape))]
    wanted = itertools.product(*[range(a // c, -(-b // c)) for (a, b), c in zip(limits, chunks)])
    keys = [(m["prefix"] + m["separator"].join(map(str, at)), *at) for at in wanted]
    grid = spark.createDataFrame(keys, "key string, " + ", ".join(f"c{k} int" for k in range(len(shape))))
    depth = (len(shape) + bool(m["prefix"])) if m["separator"] == "/" else 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    held = files.select(F.substring_index("path", "/", -depth).alias("key"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.content is None:
                    a = np.full(chunks, 0 if m["fill"] is None else float(m["fill"]))
                else:
                    data = bytes(row.content)[: -m["tail"] or None]
                    for codec in reversed(m["codecs"]):
                        data = _inflate(data, codec)
                    a = np.frombuffer(data, m["dtype"]).reshape(chunks, order=m["order"])
                starts = [getattr(row, f"c{k}") * c for k, c in enumerate(chunks)]
                cut = [slice(max(lo - s, 0), min(hi - s, c)) for (lo, hi), s, c in zip(limits, starts, chunks)]
                a = a[tuple(cut)]
                at = np.indices(a.shape).reshape(len(shape), -1)
                v = a.astype(float).ravel()
                yield pd.DataFrame({n: at[k] + starts[k] + cut[k].start for k, n in enumerate(names)} | {"v": np.where(np.isfinite(v), v, np.nan)})

    samples = grid.join(held, "key", "left").mapInPandas(decode, ", ".join(f"{n} long" for n in names) + ", v double")
    return samples.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


_KINDS = {1: ("i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}


class NetCdf:
    """Header of a classic NetCDF file (CDF-1 and CDF-2); others are rejected."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("only classic NetCDF, CDF-1 or CDF-2")
        self.data, self._at, self._wide = data, 4, data[3] == 2
        self.records = self._int()
        self.dimensions = self._list(lambda: (self._name(), self._int()))
        self.attributes = dict(self._list(self._attribute))
        self.variables = dict(self._list(self._variable))
        self.record_size = sum(v["size"] for v in self.variables.values() if v["record"])

    def _int(self) -> int:
        (x,) = struct.unpack_from(">I", self.data, self._at)
        self._at += 4
        return x

    def _name(self) -> str:
        n = self._int()
        out = self.data[self._at : self._at + n].decode()
        self._at += -(-n // 4) * 4
        return out

    def _list(self, item) -> list:
        _, n = self._int(), self._int()
        return [item() for _ in range(n)]

    def _attribute(self):
        name, kind, n = self._name(), self._int(), self._int()
        dtype, width = _KINDS[kind]
        raw = self.data[self._at : self._at + n * width]
        self._at += -(-n * width // 4) * 4
        return name, raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()

    def _variable(self):
        name = self._name()
        dims = [self._int() for _ in range(self._int())]
        attributes, kind, size = dict(self._list(self._attribute)), self._int(), self._int()
        begin = struct.unpack_from(">Q" if self._wide else ">I", self.data, self._at)[0]
        self._at += 8 if self._wide else 4
        return name, {"dims": dims, "attributes": attributes, "dtype": _KINDS[kind][0], "size": size, "begin": begin, "record": bool(dims) and self.dimensions[dims[0]][1] == 0}

    def values(self, name: str) -> np.ndarray:
        """A variable as doubles, scaled; fill values are NaN."""
        v = self.variables[name]
        shape = [self.records if k == 0 and v["record"] else self.dimensions[d][1] for k, d in enumerate(v["dims"])]
        if v["record"]:
            n = int(np.prod(shape[1:]))
            a = np.array([np.frombuffer(self.data, v["dtype"], n, v["begin"] + r * self.record_size) for r in range(self.records)]).reshape(shape)
        else:
            a = np.frombuffer(self.data, v["dtype"], int(np.prod(shape)), v["begin"]).reshape(shape)
        out = a.astype(float)
        for key in ("_FillValue", "missing_value"):
            if key in v["attributes"]:
                out = np.where(a == v["attributes"][key][0], np.nan, out)
        return out * v["attributes"].get("scale_factor", [1.0])[0] + v["attributes"].get("add_offset", [0.0])[0]


def read_netcdf(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Vector form of a variable: ``path, plane`` (leading dimensions, row-major), ``y, values``."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                a = NetCdf(bytes(data)).values(variable)
                a = a.reshape(-1, *(a.shape[-2:] if a.ndim > 1 else (1, a.size)))
                for plane, rows in enumerate(a):
                    yield pd.DataFrame({"path": p, "plane": plane, "y": range(len(rows)), "values": [[None if not np.isfinite(v) else float(v) for v in r] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, plane int, y int, values array<double>")


def world_file(text: str) -> tuple[float, float, float, float, float, float]:
    """The six lines of a world file as an affine of pixel centres."""
    a, d, b, e, c, f = (float(x) for x in text.split())
    return a, b, c, d, e, f
