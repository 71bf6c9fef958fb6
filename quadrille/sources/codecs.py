"""Decoders and encoders of simple raster files, as numpy arrays ``planes x height x width``.

Formats with entropy or transform coding (JPEG, JPEG 2000, JPEG XL, WebP, AVIF, HEIF) and HDF5
containers are not supported and say so.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zlib

import numpy as np

UNSUPPORTED = {"jpeg": b"\xff\xd8\xff", "jp2": b"\x00\x00\x00\x0cjP  ", "jxl": b"\xff\x0a", "webp": b"RIFF", "hdf5": b"\x89HDF\r\n\x1a\n", "gif": b"GIF8"}


def sniff(data: bytes, path: str = "") -> str:
    """The format's name by magic bytes, then by the path's extension; unknown or unsupported formats raise."""
    head, ext = data[:512], path.rsplit(".", 1)[-1].lower()
    for name, magic in UNSUPPORTED.items():
        if head.startswith(magic):
            raise ValueError(f"{name} is not supported")
    for name, magic in (("npy", b"\x93NUMPY"), ("png", b"\x89PNG\r\n\x1a\n"), ("bmp", b"BM"), ("qoi", b"qoif"), ("fits", b"SIMPLE  ="), ("nrrd", b"NRRD"), ("gsf", b"Gwyddion Simple Field 1.0\n"), ("tiff", b"II*\0"), ("tiff", b"MM\0*")):
        if head.startswith(magic):
            return name
    if re.match(rb"P[1-6fF]\s", head):
        return "netpbm"
    if head[344:348] in (b"n+1\0", b"ni1\0"):
        return "nifti"
    if head[208:212] == b"MAP ":
        return "mrc"
    if re.match(rb"(?i)\s*ncols\s", head):
        return "esri-ascii"
    if re.match(rb"(?i)ObjectType\s*=|NDims\s*=", head):
        return "meta-image"
    if ext in ("hgt", "tga"):
        return ext
    if re.match(rb"(?i)#FORMAT\s*:\s*EMSA", head):
        return "emsa"
    raise ValueError(f"unknown raster format: {path}")


def decode(data: bytes, path: str = "") -> np.ndarray:
    out = DECODERS[sniff(data, path)](data)
    return out[None] if out.ndim == 2 else out.reshape(-1, *out.shape[-2:])


def _channels(a: np.ndarray) -> np.ndarray:
    return np.moveaxis(a, -1, 0) if a.ndim == 3 else a


def npy(data: bytes) -> np.ndarray:
    a = np.load(io.BytesIO(data), allow_pickle=False)
    return a.reshape(1, -1) if a.ndim < 2 else a


def esri_ascii(data: bytes) -> np.ndarray:
    text, head = data.decode("ascii"), {}
    at = 0
    while m := re.compile(r"\s*([A-Za-z_]+)\s+(\S+)").match(text, at):
        head[m[1].lower()] = float(m[2])
        at = m.end()
    a = np.array(text[at:].split(), dtype=float).reshape(int(head["nrows"]), int(head["ncols"]))
    return np.where(a == head.get("nodata_value", -9999.0), np.nan, a)


def hgt(data: bytes) -> np.ndarray:
    side = int(round((len(data) / 2) ** 0.5))
    if side * side * 2 != len(data):
        raise ValueError("an HGT tile is square")
    a = np.frombuffer(data, ">i2").reshape(side, side)
    return np.where(a == -32768, np.nan, a)


def netpbm(data: bytes) -> np.ndarray:
    kind = chr(data[1])
    want = 2 if kind in "14" else 3
    token, at, found = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)"), 2, []
    while len(found) < want:
        m = token.match(data, at)
        found.append(m[1])
        at = m.end()
    w, h = int(found[0]), int(found[1])
    bands = 3 if kind in "36F" else 1
    if kind in "fF":
        scale = float(found[2])
        a = np.frombuffer(data, "<f4" if scale < 0 else ">f4", w * h * bands, at + 1).reshape(h, w, bands)[::-1]
    elif kind == "4":
        a = 1 - np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w, None]
    elif kind in "56":
        a = np.frombuffer(data, np.uint8 if int(found[2]) < 256 else ">u2", w * h * bands, at + 1).reshape(h, w, bands)
    else:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        a = 1 - np.array([c - 48 for c in body if c in b"01"]).reshape(h, w, 1) if kind == "1" else np.array(body.split(), dtype=int).reshape(h, w, bands)
    return _channels(a)


def bmp(data: bytes) -> np.ndarray:
    offset, size, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    if h > 0:
        a = a[::-1]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, (offset - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        a = colours[a[..., 0]]
    return _channels(a[..., [2, 1, 0]])


def tga(data: bytes) -> np.ndarray:
    ident, _, kind, w, h, bits, flags = data[0], data[1], data[2], *struct.unpack_from("<HHBB", data, 12)
    if kind not in (2, 3) or bits not in (8, 24, 32):
        raise ValueError("only uncompressed true-colour or grey TGA")
    a = np.frombuffer(data, np.uint8, w * h * bits // 8, 18 + ident).reshape(h, w, bits // 8)
    a = a if flags & 32 else a[::-1]
    return _channels(a if bits == 8 else a[..., [2, 1, 0, 3][: bits // 8]])


def qoi(data: bytes) -> np.ndarray:
    w, h, bands = struct.unpack_from(">IIB", data, 4)
    out, seen = np.zeros((w * h, 4), np.uint8), [(0, 0, 0, 0)] * 64
    px, at, k = (0, 0, 0, 255), 14, 0
    while k < w * h:
        b = data[at]
        at += 1
        run = 1
        if b == 254:
            px, at = (*data[at : at + 3], px[3]), at + 3
        elif b == 255:
            px, at = tuple(data[at : at + 4]), at + 4
        elif b >> 6 == 0:
            px = seen[b]
        elif b >> 6 == 1:
            px = tuple((p + (b >> s & 3) - 2) & 255 for p, s in zip(px, (4, 2, 0))) + px[3:]
        elif b >> 6 == 2:
            g, d = (b & 63) - 32, data[at]
            at += 1
            px = ((px[0] + g + (d >> 4) - 8) & 255, (px[1] + g) & 255, (px[2] + g + (d & 15) - 8) & 255, px[3])
        else:
            run = (b & 63) + 1
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out[k : k + run] = px
        k += run
    return _channels(out.reshape(h, w, 4)[..., :bands])


def png(data: bytes) -> np.ndarray:
    at, body, table = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk's checksum is wrong")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            table = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    if interlace or depth not in (8, 16):
        raise ValueError("only PNG of 8 or 16 bits without interlacing")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = bands * depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        how, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if how == 1:
            line = (np.cumsum(line.reshape(w, step), axis=0) & 255).ravel()
        elif how == 2:
            line = (line + above) & 255
        elif how in (3, 4):
            for i in range(w * step):
                left = line[i - step] if i >= step else 0
                corner = above[i - step] if i >= step else 0
                if how == 3:
                    guess = (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))[2]
                line[i] = (line[i] + guess) & 255
        out[y] = above = line
    a = out.reshape(h, w, bands) if depth == 8 else out.reshape(h, -1).view(">u2").reshape(h, w, bands)
    return _channels(table[a[..., 0]] if colour == 3 else a)


def gsf(data: bytes) -> np.ndarray:
    end = data.index(b"\0")
    head = dict(line.split("=", 1) for line in data[:end].decode("utf-8").split("\n")[1:] if "=" in line)
    head = {k.strip(): v.strip() for k, v in head.items()}
    w, h = int(head["XRes"]), int(head["YRes"])
    return np.frombuffer(data, "<f4", w * h, end + 4 - end % 4).reshape(h, w)


def fits(data: bytes) -> np.ndarray:
    head, at = {}, 0
    while True:
        card = data[at : at + 80].decode("ascii")
        at += 80
        if card.startswith("END"):
            break
        if card[8:10] == "= ":
            head[card[:8].strip()] = card[10:].split("/")[0].strip()
    at = -(-at // 2880) * 2880
    shape = [int(head[f"NAXIS{k}"]) for k in range(int(head["NAXIS"]), 0, -1)]
    a = np.frombuffer(data, {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(head["BITPIX"])], int(np.prod(shape)), at).reshape(shape)
    blank = a == int(head["BLANK"]) if "BLANK" in head else None
    a = a * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
    return np.where(blank, np.nan, a) if blank is not None else a


_NUMBERS = {"uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}


def nrrd(data: bytes) -> np.ndarray:
    head_end = data.index(b"\n\n")
    head = dict(re.findall(r"^([\w ]+): *(.*)$", data[:head_end].decode("ascii"), re.M))
    body = data[head_end + 2 :]
    body = gzip.decompress(body) if head["encoding"] in ("gzip", "gz") else body
    sizes = [int(x) for x in head["sizes"].split()][::-1]
    order = ">" if head.get("endian", "little") == "big" else "<"
    return np.frombuffer(body, order + _NUMBERS[head["type"]], int(np.prod(sizes))).reshape(sizes)


def meta_image(data: bytes) -> np.ndarray:
    m = re.search(rb"ElementDataFile\s*=\s*LOCAL\r?\n", data)
    if not m:
        raise ValueError("only MetaImage with its data inside")
    head = dict(re.findall(r"^(\w+)\s*=\s*(.*?)\s*$", data[: m.start()].decode("ascii"), re.M))
    sizes = [int(x) for x in head["DimSize"].split()][::-1]
    body = zlib.decompress(data[m.end() :]) if head.get("CompressedData", "False") == "True" else data[m.end() :]
    order = ">" if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True" else "<"
    return np.frombuffer(body, order + _NUMBERS[head["ElementType"].removeprefix("MET_").lower()], int(np.prod(sizes))).reshape(sizes)


def nifti(data: bytes) -> np.ndarray:
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    dim = struct.unpack_from(order + "8h", data, 40)
    kind, start = struct.unpack_from(order + "h", data, 70)[0], int(struct.unpack_from(order + "f", data, 108)[0])
    slope, inter = struct.unpack_from(order + "2f", data, 112)
    shape = dim[1 : 1 + dim[0]][::-1]
    a = np.frombuffer(data, order + {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}[kind], int(np.prod(shape)), start).reshape(shape)
    return a * slope + inter if slope else a


def mrc(data: bytes) -> np.ndarray:
    order = "<" if data[212] in (0x44, 0) else ">"
    nx, ny, nz, mode = struct.unpack_from(order + "4i", data)
    extra = struct.unpack_from(order + "i", data, 92)[0]
    return np.frombuffer(data, order + {0: "i1", 1: "i2", 2: "f4", 6: "u2"}[mode], nx * ny * nz, 1024 + extra).reshape(nz, ny, nx)


def emsa(data: bytes) -> np.ndarray:
    body = re.split(r"(?im)^#SPECTRUM.*$", data.decode("ascii", "replace"))[1]
    rows = [[float(x) for x in re.findall(r"[-+.\dEe]+", line)] for line in body.splitlines() if line.strip() and not line.startswith("#")]
    xy = "XY" in data[:4000].decode("ascii", "replace").upper().split("#DATATYPE")[-1][:40]
    return np.array([[r[1] for r in rows]] if xy else [[v for r in rows for v in r]])


def envi(header: str, data: bytes) -> np.ndarray:
    """Raw samples under an ENVI header (a file of its own)."""
    head = {k.strip().lower(): v.strip() for k, v in re.findall(r"^([\w ]+?)\s*=\s*(\{[^}]*\}|.*)$", header, re.M)}
    w, h, b = int(head["samples"]), int(head["lines"]), int(head.get("bands", 1))
    kind = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}[int(head["data type"])]
    a = np.frombuffer(data, ("<" if head.get("byte order", "0") == "0" else ">") + kind, w * h * b, int(head.get("header offset", 0)))
    shape, axes = {"bsq": ((b, h, w), (0, 1, 2)), "bil": ((h, b, w), (1, 0, 2)), "bip": ((h, w, b), (2, 0, 1))}[head.get("interleave", "bsq").lower()]
    return a.reshape(shape).transpose(axes)


def tiff(data: bytes) -> np.ndarray:
    """First page: strips, uncompressed or deflated, chunky samples."""
    o = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(o + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(o + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(o + "HHI", data, at + 2 + 12 * k)
        code, width = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
        place = at + 10 + 12 * k if n * width <= 4 else struct.unpack_from(o + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(f"{o}{n}{code}", data, place) if kind in (1, 3, 4) else ()
    get = lambda t, d=None: tags[t][0] if t in tags else d
    if get(259, 1) not in (1, 8, 32946) or 322 in tags or get(284, 1) != 1:
        raise ValueError("only TIFF in strips, uncompressed or deflated")
    parts = [data[a : a + n] for a, n in zip(tags[273], tags[279])]
    body = b"".join(zlib.decompress(p) if get(259, 1) != 1 else p for p in parts)
    w, h, bands, bits = get(256), get(257), get(277, 1), get(258, 8)
    a = np.frombuffer(body, o + {1: "u", 2: "i", 3: "f"}[get(339, 1)] + str(bits // 8), w * h * bands).reshape(h, w, bands)
    if get(317, 1) == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    return _channels(a)


DECODERS = {"npy": npy, "png": png, "bmp": bmp, "qoi": qoi, "fits": fits, "nrrd": nrrd, "gsf": gsf, "tiff": tiff, "netpbm": netpbm, "nifti": nifti, "mrc": mrc, "esri-ascii": esri_ascii, "meta-image": meta_image, "hgt": hgt, "tga": tga, "emsa": emsa}


def _image(a: np.ndarray) -> np.ndarray:
    """Planes to ``height x width x channels`` bytes."""
    return np.moveaxis(np.clip(np.floor(np.nan_to_num(a) + 0.5), 0, 255).astype(np.uint8), 0, -1)


def encode(a: np.ndarray, format: str) -> bytes:
    """Planes (1 grey, 3 RGB, 4 RGBA) to a file."""
    if format == "npy":
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()
    if format == "pfm":
        body = np.moveaxis(a, 0, -1)[::-1].astype("<f4").tobytes()
        return b"%s\n%d %d\n-1.0\n" % (b"PF" if len(a) == 3 else b"Pf", a.shape[2], a.shape[1]) + body
    x = _image(a)
    h, w, bands = x.shape
    if format in ("pgm", "ppm"):
        return b"P%d\n%d %d\n255\n" % (5 if bands == 1 else 6, w, h) + x.tobytes()
    if format == "png":
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        lines = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1)], axis=1).tobytes()
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[bands], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    if format == "bmp":
        rgb = np.repeat(x, 3, axis=2) if bands == 1 else x[..., :3]
        stride = (w * 3 + 3) // 4 * 4
        body = np.zeros((h, stride), np.uint8)
        body[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
        return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()
    if format == "tga":
        order = [0] if bands == 1 else [2, 1, 0, 3][:bands]
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if bands == 1 else 2, 0, 0, 0, 0, 0, w, h, 8 * bands, 32) + x[..., order].tobytes()
    raise ValueError(f"{format} can't be written")
