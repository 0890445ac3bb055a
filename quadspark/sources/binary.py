"""Binary formats by numpy: PNG images, GeoTIFF rasters, quantised meshes and GLB meshes.

The codecs work on one image or mesh; the DataFrame functions map them over rows or group by mesh.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.local import MESH, _parts, _rows, joined, split
from ..operators.mesh import M

# -- PNG --------------------------------------------------------------------------------------------------------------


def png(image: np.ndarray) -> bytes:
    """8-bit PNG of an array (height, width) or (height, width, 3 or 4)."""
    a = np.ascontiguousarray(image, dtype=np.uint8)
    h, w = a.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), a.reshape(h, -1)), axis=1).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


def read_png(content: bytes) -> np.ndarray:
    """Array of an 8-bit PNG without interlace: grey, RGB or RGBA."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data = 8, b""
    while at < len(content):
        n, name = struct.unpack(">I4s", content[at : at + 8])
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif name == b"IDAT":
            data += content[at + 8 : at + 8 + n]
        at += 12 + n
    if depth != 8 or lace or kind not in (0, 2, 6):
        raise ValueError("only plain 8-bit grey, RGB and RGBA images are read")
    k = {0: 1, 2: 3, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, 1 + w * k)
    out = np.zeros((h, w * k), dtype=np.uint8)
    up = np.zeros(w * k, dtype=np.int64)
    for y in range(h):
        filt, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if filt == 0:
            cur = line
        elif filt == 2:
            cur = line + up
        else:
            cur = np.zeros(w * k, dtype=np.int64)
            for i in range(w * k):
                left, corner = (cur[i - k], up[i - k]) if i >= k else (0, 0)
                if filt == 1:
                    p = left
                elif filt == 3:
                    p = (left + up[i]) // 2
                else:
                    e = left + up[i] - corner
                    d = abs(e - left), abs(e - up[i]), abs(e - corner)
                    p = left if d[0] <= d[1] and d[0] <= d[2] else up[i] if d[1] <= d[2] else corner
                cur[i] = line[i] + p & 255
        up = cur & 255
        out[y] = up
    return out.reshape((h, w) if k == 1 else (h, w, k))


# -- GeoTIFF ----------------------------------------------------------------------------------------------------------

_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}


def geotiff(z: np.ndarray, gt: tuple[float, float, float, float], epsg: int, no_data: float | None = None) -> bytes:
    """Deflated single-band 32 or 64-bit float raster; gt is x of the left edge, width, y of the upper edge, height (negative) of a pixel."""
    z = np.ascontiguousarray(z, dtype="<f4" if z.dtype == np.float32 else "<f8")
    h, w = z.shape
    data = zlib.compress(z.tobytes())
    model = (1024, 0, 1, 2 if epsg == 4326 else 1)
    keys = (1, 1, 0, 3, *model, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    tags: list[tuple[int, int, tuple]] = [
        (256, 4, (w,)), (257, 4, (h,)), (258, 3, (z.itemsize * 8,)), (259, 3, (8,)), (262, 3, (1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (h,)),
        (279, 4, (len(data),)), (339, 3, (3,)), (33550, 12, (gt[1], -gt[3], 0.0)), (33922, 12, (0.0, 0.0, 0.0, gt[0], gt[2], 0.0)), (34735, 3, keys),
    ]
    if no_data is not None:
        tags.append((42113, 2, tuple(bytes([b]) for b in f"{no_data:.17g}".encode() + b"\0")))
    pad = -len(data) % 8
    at, extra, rows = 8 + len(data) + pad, b"", b""
    at += 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = b"".join(struct.pack("<" + _TYPES[kind], v) for v in values)
        if len(raw) > 4:
            rows += struct.pack("<HHII", tag, kind, len(values), at + len(extra))
            extra += raw + b"\0" * (-len(raw) % 8)
        else:
            rows += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + pad) + data + b"\0" * pad + struct.pack("<H", len(tags)) + rows + struct.pack("<I", 0) + extra


def read_geotiff(content: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], int | None, float | None]:
    """First band as float64 with nan for no data, geotransform, EPSG code and no-data value.

    Little and big endian, strips or tiles, plain or deflated; a rotated transform is an error."""
    e = {b"II": "<", b"MM": ">"}[content[:2]]
    if struct.unpack(e + "H", content[2:4])[0] != 42:
        raise ValueError("no classic TIFF")
    at = struct.unpack(e + "I", content[4:8])[0]
    tags = {}
    for i in range(struct.unpack(e + "H", content[at : at + 2])[0]):
        p = at + 2 + 12 * i
        tag, kind, n = struct.unpack(e + "HHI", content[p : p + 8])
        c = _TYPES.get(kind)
        if c is None:
            continue
        size = struct.calcsize(e + c) * n
        q = p + 8 if size <= 4 else struct.unpack(e + "I", content[p + 8 : p + 12])[0]
        tags[tag] = content[q : q + n] if kind == 2 else struct.unpack(e + c * n, content[q : q + size])
    w, h, bits, bands = tags[256][0], tags[257][0], tags[258][0], tags.get(277, (1,))[0]
    dtype = np.dtype(e + {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(bits // 8))
    tiled = 322 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, tags.get(278, (h,))[0])
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.zeros((-(-h // bh) * bh, -(-w // bw) * bw))
    for i, (o, n) in enumerate(zip(offsets, sizes, strict=True)):
        raw = content[o : o + n]
        if tags.get(259, (1,))[0] in (8, 32946):
            raw = zlib.decompress(raw)
        elif tags.get(259, (1,))[0] != 1:
            raise ValueError("compression is not supported")
        a = np.frombuffer(raw, dtype=dtype)
        rows = min(len(a) // (bw * bands), bh)
        r, c = divmod(i, out.shape[1] // bw)
        if r * bh < out.shape[0]:
            out[r * bh : r * bh + rows, c * bw : (c + 1) * bw] = a[: rows * bw * bands].reshape(rows, bw, bands)[:, :, 0]
    if 34264 in tags:
        m = tags[34264]
        if m[1] or m[4]:
            raise ValueError("the raster is rotated")
        gt = (m[3], m[0], m[7], m[5])
    else:
        s, t = tags.get(33550, (1.0, -1.0, 0.0)), tags.get(33922, (0.0,) * 6)
        gt = (t[3] - t[0] * s[0], s[0], t[4] + t[1] * s[1], -s[1])
    keys = tags.get(34735, (0,) * 4)
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    none = float(tags[42113].rstrip(b"\0 ")) if 42113 in tags else None
    z = out[:h, :w]
    return np.where(z == none, np.nan, z) if none is not None else z, gt, codes.get(3072) or codes.get(2048), none


def read_rasters(files: DataFrame) -> DataFrame:
    """Pixels (raster_id, row, col, z) of GeoTIFF rows (name, content); a file is one task's at a time."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                z, *_ = read_geotiff(bytes(content))
                r, c = np.indices(z.shape)
                flat = z.ravel()
                yield pd.DataFrame({"raster_id": name, "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "z": np.where(np.isnan(flat), None, flat).astype(object)})

    return files.select("name", "content").mapInPandas(run, "raster_id string, row int, col int, z double")


def geotiff_files(pixels: DataFrame, gt: tuple[float, float, float, float], epsg: int, no_data: float = -9999.0) -> DataFrame:
    """path and content of a GeoTIFF for each raster (raster_id, row, col, z); missing pixels hold the no-data value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(pdf.row.max()) + 1, int(pdf.col.max()) + 1), no_data)
        ok = pdf.z.notna()
        a[pdf.row[ok], pdf.col[ok]] = pdf.z[ok]
        return pd.DataFrame({"path": [f"{pdf.raster_id.iloc[0]}.tif"], "content": [geotiff(a, gt, epsg, no_data)]})

    return pixels.select("raster_id", "row", "col", "z").groupBy("raster_id").applyInPandas(run, "path string, content binary")


def raster_headers(files: DataFrame) -> DataFrame:
    """raster_id, epsg, width, height, geotransform and no-data value of GeoTIFF rows."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                z, gt, epsg, none = read_geotiff(bytes(content))
                yield pd.DataFrame({"raster_id": [name], "epsg": [epsg], "width": [z.shape[1]], "height": [z.shape[0]], "gt": [[*map(float, gt)]], "nodata": [none]})

    return files.select("name", "content").mapInPandas(run, "raster_id string, epsg int, width int, height int, gt array<double>, nodata double")


# -- quantised meshes -------------------------------------------------------------------------------------------------

TOP = 32767


def quantized_mesh(u: np.ndarray, v: np.ndarray, h: np.ndarray, faces: np.ndarray, header: dict) -> bytes:
    """A quantised mesh of integer streams (0 to 32767) and faces; vertices are put in the order in which faces name them.

    header: centre, min_h, max_h, sphere (centre and radius), occlusion."""
    flat, order, seen = faces.ravel(), [], {}
    for i in flat.tolist():
        if i not in seen:
            seen[i] = len(order)
            order.append(i)
    idx = np.array([seen[i] for i in flat.tolist()], dtype=np.int64)
    n = len(order)
    high = np.maximum.accumulate(np.concatenate(([0], idx + 1)))[:-1]
    codes = high - idx
    wide = n > 65536
    t = "<u4" if wide else "<u2"
    out = struct.pack("<3d2f3dd3d", *header["centre"], header["min_h"], header["max_h"], *header["sphere"], *header["occlusion"])
    out += struct.pack("<I", n)
    for s in (u, v, h):
        d = np.diff(np.asarray(s, dtype=np.int64)[order], prepend=0)
        out += ((d << 1) ^ (d >> 63)).astype("<u2").tobytes()
    out += b"\xca" * (-len(out) % (4 if wide else 2))
    out += struct.pack("<I", len(faces)) + codes.astype(t).tobytes()
    uo, vo = np.asarray(u)[order], np.asarray(v)[order]
    for side in (uo == 0, vo == 0, uo == TOP, vo == TOP):
        own = np.flatnonzero(side)
        out += struct.pack("<I", len(own)) + own.astype(t).tobytes()
    return out


def read_quantized_mesh(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]:
    """Streams u, v and h, faces and header of a quantised mesh, plain or gzipped; edge lists and extensions are skipped."""
    if content[:2] == b"\x1f\x8b":
        content = zlib.decompress(content, 47)
    x = struct.unpack("<3d2f3dd3d", content[:88])
    n = struct.unpack("<I", content[88:92])[0]
    at, streams = 92, []
    for _ in range(3):
        z = np.frombuffer(content, dtype="<u2", count=n, offset=at).astype(np.int64)
        streams.append(np.cumsum((z >> 1) ^ -(z & 1)))
        at += 2 * n
    wide = n > 65536
    at += -at % (4 if wide else 2)
    m = struct.unpack("<I", content[at : at + 4])[0]
    codes = np.frombuffer(content, dtype="<u4" if wide else "<u2", count=3 * m, offset=at + 4).astype(np.int64)
    new = codes == 0
    idx = np.concatenate(([0], np.cumsum(new)))[:-1] - codes
    return *streams, idx.reshape(-1, 3), {"centre": x[:3], "min_h": x[3], "max_h": x[4], "sphere": x[5:9], "occlusion": x[9:12]}


# -- GLB --------------------------------------------------------------------------------------------------------------


def glb(xyz: np.ndarray, faces: np.ndarray, uv: np.ndarray | None = None, texture: bytes | None = None, extras: dict | None = None) -> bytes:
    """A GLB mesh.  Positions are 32-bit floats around the mean, which nested nodes carry in three parts (whole, fraction and
    rest) so that doubles come back to the precision of the floats around the mean."""
    p = np.asarray(xyz, dtype=np.float64)
    mean = p.mean(axis=0) if len(p) else np.zeros(3)
    coarse = mean.astype(np.float32).astype(np.float64)
    fine = (mean - coarse).astype(np.float32).astype(np.float64)
    local = (p - coarse - fine).astype("<f4")
    chunks = [np.asarray(faces, dtype="<u4").tobytes(), local.tobytes()]
    accessors = [
        {"bufferView": 0, "componentType": 5125, "count": int(np.size(faces)), "type": "SCALAR"},
        {"bufferView": 1, "componentType": 5126, "count": len(p), "type": "VEC3", "min": local.min(axis=0).tolist() if len(p) else [0, 0, 0], "max": local.max(axis=0).tolist() if len(p) else [0, 0, 0]},
    ]
    primitive: dict = {"attributes": {"POSITION": 1}, "indices": 0, "mode": 4}
    if uv is not None:
        chunks.append(np.asarray(uv, dtype="<f4").tobytes())
        primitive["attributes"]["TEXCOORD_0"] = 2
        accessors.append({"bufferView": 2, "componentType": 5126, "count": len(p), "type": "VEC2"})
    doc: dict = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "accessors": accessors, "meshes": [{"primitives": [primitive]}],
        "nodes": [{"translation": coarse.tolist(), "children": [1]}, {"translation": fine.tolist(), "children": [2]}, {"mesh": 0}],
    }
    if texture is not None:
        chunks.append(texture)
        doc |= {"images": [{"bufferView": len(chunks) - 1, "mimeType": "image/png"}], "textures": [{"source": 0}], "materials": [{"pbrMetallicRoughness": {"baseColorTexture": {"index": 0}, "metallicFactor": 0}}]}
        primitive["material"] = 0
    if extras:
        doc["extras"] = extras
    views, body = [], b""
    for c in chunks:
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(c)})
        body += c + b"\0" * (-len(c) % 4)
    doc |= {"bufferViews": views, "buffers": [{"byteLength": len(body)}]}
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body


def read_glb(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, bytes | None, dict]:
    """Positions (with the translations of the mesh's node and those above it), faces, texture coordinates, texture bytes and
    extras; anything but one mesh with one triangle primitive is an error."""
    magic, _, _ = struct.unpack("<4sII", content[:12])
    if magic != b"glTF":
        raise ValueError("no GLB")
    n = struct.unpack("<I", content[12:16])[0]
    doc, body = json.loads(content[20 : 20 + n]), content[28 + n :]
    if len(doc.get("meshes", [])) != 1 or len(doc["meshes"][0]["primitives"]) != 1 or doc["meshes"][0]["primitives"][0].get("mode", 4) != 4:
        raise ValueError("one mesh with one triangle primitive is expected")
    prim = doc["meshes"][0]["primitives"][0]

    def array(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        v = doc["bufferViews"][a["bufferView"]]
        k = {"SCALAR": 1, "VEC2": 2, "VEC3": 3}[a["type"]]
        d = np.frombuffer(body, dtype={5121: "<u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}[a["componentType"]], count=a["count"] * k, offset=v.get("byteOffset", 0) + a.get("byteOffset", 0))
        return d.reshape(-1, k) if k > 1 else d

    up = {c: i for i, node in enumerate(doc["nodes"]) for c in node.get("children", [])}
    at: int | None = next(i for i, node in enumerate(doc["nodes"]) if "mesh" in node)
    move = np.zeros(3)
    while at is not None:
        move = move + np.array(doc["nodes"][at].get("translation", (0, 0, 0)), dtype=np.float64)
        at = up.get(at)
    uv = array(prim["attributes"]["TEXCOORD_0"]).astype(np.float64) if "TEXCOORD_0" in prim["attributes"] else None
    texture = None
    if "material" in prim:
        image = doc["images"][doc["textures"][doc["materials"][prim["material"]]["pbrMetallicRoughness"]["baseColorTexture"]["index"]]["source"]]
        v = doc["bufferViews"][image["bufferView"]]
        texture = bytes(body[v.get("byteOffset", 0) : v.get("byteOffset", 0) + v["byteLength"]])
    return array(prim["attributes"]["POSITION"]).astype(np.float64) + move, array(prim["indices"]).astype(np.int64).reshape(-1, 3), uv, texture, doc.get("extras", {})


def glb_files(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """path and content of a GLB file for each mesh."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, f, uv = _parts(pdf)
        return pd.DataFrame({"path": [f"{pdf[M].iloc[0]}.glb"], "content": [glb(p, f, None if np.isnan(uv).any() else uv)]})

    return joined(vertices, faces).groupBy(M).applyInPandas(run, "path string, content binary")


def read_glb_files(files: DataFrame) -> DataFrame:
    """Meshes of GLB rows (name, content), as rows that `split` parts; the mesh's number is the name."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                p, f, uv, _, _ = read_glb(bytes(content))
                yield _rows(int(name), p, f, uv)

    return files.select("name", "content").mapInPandas(run, MESH)


HEAD = ("cx", "cy", "cz", "min_h", "max_h", "radius", "ox", "oy", "oz")


def quantized_mesh_files(vertices: DataFrame, faces: DataFrame, header: DataFrame, packed: bool = False) -> DataFrame:
    """path and content of a quantised mesh for each mesh: vertices (mesh_id, vid, u, v, h) as integers, header rows as
    `encode.header` gives them; `packed` ones are gzipped."""
    rows = vertices.selectExpr(f"cast({M} as long) {M}", "'vertex' as kind", "cast(vid as long) i", "cast(u as double) a", "cast(v as double) b", "cast(h as double) c", "cast(0 as double) u", "cast(0 as double) v")
    rows = rows.unionByName(faces.selectExpr(f"cast({M} as long) {M}", "'face' as kind", "cast(fid as long) i", "cast(a as double) a", "cast(b as double) b", "cast(c as double) c", "cast(0 as double) u", "cast(0 as double) v"))
    rows = rows.join(header.select(F.col(M).cast("long").alias(M), *HEAD), M)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, f, _ = _parts(pdf)
        x = pdf.iloc[0]
        q = p.astype(np.int64)
        centre = (x.cx, x.cy, x.cz)
        h = {"centre": centre, "min_h": x.min_h, "max_h": x.max_h, "sphere": (*centre, x.radius), "occlusion": (x.ox, x.oy, x.oz)}
        content = quantized_mesh(q[:, 0], q[:, 1], q[:, 2], f, h)
        return pd.DataFrame({"path": [f"{x[M]}.terrain{'.gz' if packed else ''}"], "content": [gzip.compress(content, 9, mtime=0) if packed else content]})

    return rows.groupBy(M).applyInPandas(run, "path string, content binary")


def read_quantized_mesh_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices (mesh_id, vid, u, v, h as integers), faces and headers (as `encode.header` gives them) of quantised meshes, plain
    or gzipped, from rows (name, content); the mesh's number is the name."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                u, v, h, f, _ = read_quantized_mesh(bytes(content))
                yield _rows(int(name), np.stack((u, v, h), axis=1).astype(float), f)

    def heads(frames):
        for pdf in frames:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                x = read_quantized_mesh(bytes(content))[4]
                yield pd.DataFrame([(int(name), *x["centre"], x["min_h"], x["max_h"], x["sphere"][3], *x["occlusion"])], columns=[M, *HEAD])

    v, f = split(files.select("name", "content").mapInPandas(run, MESH))
    v = v.selectExpr(M, "vid", "cast(x as int) u", "cast(y as int) v", "cast(z as int) h")
    return v, f, files.select("name", "content").mapInPandas(heads, f"{M} long, " + ", ".join(f"{c} double" for c in HEAD))


def read_quantized_mesh_corners(files: DataFrame) -> DataFrame:
    """Faces (mesh_id, fid, and u, v, h as integers of each corner: au .. ch) of the same; corners are looked up where a file is
    read, so that no join deals out the vertices."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf.name, pdf.content, strict=True):
                *streams, f, _ = read_quantized_mesh(bytes(content))
                yield pd.DataFrame({M: int(name), "fid": np.arange(len(f))} | {f"{k}{c}": s[f[:, i]] for i, k in enumerate("abc") for c, s in zip("uvh", streams, strict=True)})

    return files.select("name", "content").mapInPandas(run, f"{M} long, fid long, " + ", ".join(f"{k}{c} int" for k in "abc" for c in "uvh"))


# -- image tiles ------------------------------------------------------------------------------------------------------


def png_files(pixels: DataFrame, path, channels: int = 1) -> DataFrame:
    """path and content of a PNG for each image (image_id, row, col, and value or r, g, b); `path` makes a Column of image_id."""
    names = ["value"] if channels == 1 else ["r", "g", "b"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf.row.max()) + 1, int(pdf.col.max()) + 1, channels), dtype=np.uint8)
        for k, n in enumerate(names):
            a[pdf.row, pdf.col, k] = pdf[n]
        return pd.DataFrame({"path": [pdf.path.iloc[0]], "content": [png(a[:, :, 0] if channels == 1 else a)]})

    return pixels.select(path(F.col("image_id")).alias("path"), "row", "col", *names).groupBy("path").applyInPandas(run, "path string, content binary")


def png_pixels(files: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Pixels (kept columns, row, col, channel, value) of PNG rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(*keep).schema)

    def run(frames):
        for pdf in frames:
            for _, r in pdf.iterrows():
                a = read_png(bytes(r.content))
                a = a[:, :, None] if a.ndim == 2 else a
                i, j, k = (x.ravel().astype(np.int32) for x in np.indices(a.shape))
                yield pd.DataFrame({n: [r[n]] * a.size for n in keep} | {"row": i, "col": j, "channel": k, "value": a.ravel().astype(np.int32)})

    return files.select(*keep, "content").mapInPandas(run, f"{schema}, row int, col int, channel int, value int")
