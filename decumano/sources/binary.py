"""Files of many kinds as DataFrames: each file is parsed by one task from its bytes."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below ``path``; unread columns are not loaded."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def parsed(df: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, <schema>) of what ``parse`` yields for each file; a file that can't be read gives no row."""
    names = [c.strip().split()[0].strip(":") for c in _split_schema(schema)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    rows.extend(parse(bytes(content)))
                except (ValueError, KeyError, struct.error, zipfile.BadZipFile, ET.ParseError, IndexError):
                    pass
                for k in range(0, len(rows), 50_000):
                    out = pd.DataFrame(rows[k : k + 50_000], columns=names)
                    out.insert(0, "path", path)
                    yield out

    return df.select("path", "content").mapInPandas(run, f"path string, {schema}")


def _split_schema(s: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in s:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


# Workbooks


def _xlsx(content: bytes) -> Iterator[tuple]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", ns)}
    for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
        target = targets[s.get(f"{{{ns['r']}}}id")].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for c in root.iter(f"{{{ns['m']}}}c"):
            ref, kind = c.get("r") or "", c.get("t")
            letters = "".join(x for x in ref if x.isalpha())
            col = 0
            for x in letters:
                col = col * 26 + ord(x.upper()) - 64
            v = c.find("m:v", ns)
            text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else v.text if v is not None else None
            if text is not None and text != "":
                yield s.get("name"), int(ref[len(letters) :]), col, text


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, foglio, riga, colonna, valore) of all filled cells of .xlsx files, as text, rows and columns from 1."""
    return parsed(files(spark, path, "*.xlsx"), _xlsx, "foglio string, riga int, colonna int, valore string")


# Vector files


def wkb(raw: bytes, at: int = 0) -> tuple[str, list[list[tuple[float, float, float]]], int]:
    """(type, parts, end): points, lines and rings of a WKB geometry; z is NaN where there is none."""
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    has_z = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
    kind = code & 0xFFFF
    kind = kind % 1000
    size = 24 if has_z else 16

    def pts(n: int, at: int) -> tuple[list[tuple[float, float, float]], int]:
        a = np.frombuffer(raw, order + "f8", n * size // 8, at).reshape(n, -1)
        z = a[:, 2] if has_z else np.full(n, np.nan)
        return list(zip(a[:, 0].tolist(), a[:, 1].tolist(), z.tolist())), at + n * size

    if kind == 1:
        p, at = pts(1, at)
        return "Point", [p], at
    (n,) = struct.unpack_from(order + "I", raw, at)
    at += 4
    if kind == 2:
        p, at = pts(n, at)
        return "LineString", [p], at
    parts = []
    if kind == 3:
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", raw, at)
            p, at = pts(m, at + 4)
            parts.append(p)
        return "Polygon", parts, at
    for _ in range(n):
        _, sub, at = wkb(raw, at)
        parts += sub
    return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}.get(kind, "GeometryCollection"), parts, at


def gpkg_geometry(blob: bytes) -> tuple[str, list[list[tuple[float, float, float]]]]:
    """Type and parts of a GeoPackage blob: header, envelope, then WKB."""
    if blob[:2] != b"GP":
        return wkb(blob)[:2]
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return wkb(blob, 8 + envelope)[:2]


_PARTS = "parti array<array<struct<x: double, y: double, z: double>>>"


def _as_structs(parts: list[list[tuple[float, float, float]]]) -> list[list[dict]]:
    return [[{"x": x, "y": y, "z": None if z != z else z} for x, y, z in p] for p in parts]


def _shp(content: bytes) -> Iterator[tuple]:
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">II", content, at)
        at += 8
        (kind,) = struct.unpack_from("<I", content, at)
        body = at + 4
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<dd", content, body)
            z = struct.unpack_from("<d", content, body + 16)[0] if kind == 11 else float("nan")
            yield number, "Point", _as_structs([[(x, y, z)]])
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n = struct.unpack_from("<II", content, body + 32)
            starts = [*struct.unpack_from(f"<{n_parts}I", content, body + 40), n]
            xy = np.frombuffer(content, "<f8", 2 * n, body + 40 + 4 * n_parts).reshape(n, 2)
            z = np.frombuffer(content, "<f8", n, body + 40 + 4 * n_parts + 16 * n + 16) if kind in (13, 15) else np.full(n, np.nan)
            pts = list(zip(xy[:, 0].tolist(), xy[:, 1].tolist(), z.tolist()))
            yield number, "LineString" if kind % 10 == 3 else "Polygon", _as_structs([pts[a:b] for a, b in zip(starts, starts[1:])])
        at += words * 2


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """(path, numero, tipo, parti) of .shp files."""
    return parsed(files(spark, path, "*.shp"), _shp, f"numero int, tipo string, {_PARTS}")


def _dbf(content: bytes) -> Iterator[tuple]:
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    for i in range(n):
        rec = content[head + i * size : head + (i + 1) * size]
        if rec[:1] == b"*":
            continue
        pos, row = 1, {}
        for name, width in fields:
            raw = rec[pos : pos + width]
            pos += width
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("cp1252", "replace")
            row[name] = text.strip(" \0") or None
        yield i + 1, row


def dbf_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, numero, campi) of .dbf files, deleted records left out, fields as text."""
    return parsed(files(spark, path, "*.dbf"), _dbf, "numero int, campi map<string, string>")


def _dxf(content: bytes) -> Iterator[tuple]:
    try:
        lines = content.decode("utf-8").splitlines()
    except UnicodeDecodeError:
        lines = content.decode("cp1252", "replace").splitlines()
    pairs = [(int(a.strip()), b.strip()) for a, b in zip(lines[::2], lines[1::2])]
    inside, cur = False, None
    done: list[dict] = []
    for code, v in pairs:
        if code == 2 and v == "ENTITIES":
            inside = True
        elif code == 0 and v == "ENDSEC":
            inside = False
        elif inside and code == 0:
            if v == "VERTEX" and done and done[-1]["kind"] == "POLYLINE":
                cur = done[-1]
            elif v != "SEQEND":
                cur = {"kind": v, "layer": "0", "pts": [], "text": None, "closed": False}
                done.append(cur)
        elif inside and cur is not None:
            if code == 8 and not cur["pts"]:
                cur["layer"] = v
            elif code in (10, 11):
                cur["pts"].append([float(v), 0.0, float("nan")])
            elif code in (20, 21) and cur["pts"]:
                cur["pts"][-1][1] = float(v)
            elif code in (30, 31) and cur["pts"]:
                cur["pts"][-1][2] = float(v)
            elif code == 1:
                cur["text"] = v
            elif code == 70 and cur["kind"] in ("LWPOLYLINE", "POLYLINE"):
                cur["closed"] = bool(int(v) & 1)
    for i, e in enumerate(done, 1):
        pts = [tuple(p) for p in e["pts"]]
        if e["kind"] == "POLYLINE" and len(pts) > 1 and pts[0][:2] == (0.0, 0.0):
            pts = pts[1:]
        if len(pts) > 3 and pts[0][:2] == pts[-1][:2]:
            e["closed"], pts = True, pts[:-1]
        kind = "Polygon" if e["closed"] and len(pts) > 2 else "LineString" if len(pts) > 1 else "Text" if e["text"] is not None else "Point"
        yield i, e["kind"], e["layer"], kind, e["text"], _as_structs([pts])


def dxf_entities(spark: SparkSession, path: str) -> DataFrame:
    """(path, numero, entita, strato, gruppo, tipo, testo, parti) of .dxf drawings; closed polylines are polygons.

    ``gruppo`` is the layer name with its digits as '#', so that layers numbered by unit come together.
    """
    df = parsed(files(spark, path, "*.dxf"), _dxf, f"numero int, entita string, strato string, tipo string, testo string, {_PARTS}")
    return df.withColumn("gruppo", F.regexp_replace("strato", "[0-9]+", "#"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, tipo, coordinate, proprieta) of the features of .geojson files; coordinates stay JSON."""
    raw = files(spark, path, "*.geojson").select("path", F.decode("content", "UTF-8").alias("j"))
    f = F.from_json("j", "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>")
    return raw.select("path", F.explode(f["features"]).alias("f")).select("path", F.col("f.geometry.type").alias("tipo"), F.col("f.geometry.coordinates").alias("coordinate"), F.col("f.properties").alias("proprieta"))


# Meshes


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of .obj files: (path, n, x, y, z), n from 1, and (path, faccia, a, b, c), polygons as fans.

    Read as one text a file and split in the engine; negative numbers count from the last vertex before.
    """
    text = files(spark, path, "*.obj").select("path", F.decode("content", "UTF-8").alias("t"))
    line = text.select("path", F.posexplode(F.split("t", r"\r?\n")).alias("pos", "l"))
    num = lambda k: F.split(F.trim("l"), r"\s+")[k].try_cast("double")
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("pos")
    v = line.where("l like 'v %'").select("path", "pos", F.row_number().over(w).alias("n"), num(1).alias("x"), num(2).alias("y"), num(3).alias("z"))
    seen = F.sum(F.col("l").startswith("v ").cast("int")).over(w)
    f = line.where("l like 'v %' or l like 'f %'").withColumn("before", seen).where("l like 'f %'")
    ids = F.transform(F.filter(F.slice(F.split(F.trim("l"), r"\s+"), F.lit(2), F.size(F.split(F.trim("l"), r"\s+"))), lambda s: s != ""), lambda s: F.split(s, "/")[0].try_cast("int"))
    f = f.select("path", "pos", F.transform(ids, lambda i: F.when(i < 0, F.col("before") + 1 + i).otherwise(i)).alias("i"))
    tri = f.where("size(i) > 2").select("path", "pos", "i", F.explode(F.sequence(F.lit(1), F.size("i") - 2)).alias("k"))
    faces = tri.select("path", F.row_number().over(Window.partitionBy("path").orderBy("pos", "k")).alias("faccia"), F.col("i")[0].alias("a"), F.element_at("i", F.col("k") + 1).alias("b"), F.element_at("i", F.col("k") + 2).alias("c"))
    return v.drop("pos"), faces


_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _ply(content: bytes) -> Iterator[tuple]:
    end = content.index(b"end_header") + len(b"end_header")
    end = content.index(b"\n", end) + 1
    head = content[:end].decode("ascii", "replace").split("\n")
    form = next(h.split()[1] for h in head if h.startswith("format"))
    elements: list[tuple[str, int, list]] = []
    for h in head:
        p = h.split()
        if p[:1] == ["element"]:
            elements.append((p[1], int(p[2]), []))
        elif p[:1] == ["property"]:
            elements[-1][2].append((p[-1], ("list", p[2], p[3]) if p[1] == "list" else p[1]))
    if form == "ascii":
        rows = iter(content[end:].decode("ascii", "replace").split("\n"))
        for name, n, props in elements:
            for i in range(n):
                vals = next(rows).split()
                if name == "vertex":
                    at = {p: k for k, (p, _) in enumerate(props)}
                    yield "v", i, [float(vals[at[c]]) for c in "xyz"], None
                elif name == "face":
                    yield "f", i, None, [int(v) for v in vals[1 : 1 + int(vals[0])]]
        return
    o, at = "<" if "little" in form else ">", end
    for name, n, props in elements:
        if all(isinstance(t, str) for _, t in props):
            dt = np.dtype([(p, o + _PLY[t]) for p, t in props])
            a = np.frombuffer(content, dt, n, at)
            at += n * dt.itemsize
            if name == "vertex":
                for i, xyz in enumerate(np.stack([a[c].astype(float) for c in "xyz"], 1).tolist()):
                    yield "v", i, xyz, None
            continue
        for i in range(n):
            for _, t in props:
                if isinstance(t, tuple):
                    c, v = np.dtype(o + _PLY[t[1]]), np.dtype(o + _PLY[t[2]])
                    k = int(np.frombuffer(content, c, 1, at)[0])
                    ids = np.frombuffer(content, v, k, at + c.itemsize)
                    at += c.itemsize + k * v.itemsize
                    if name == "face":
                        yield "f", i, None, ids.astype(int).tolist()
                else:
                    at += np.dtype(_PLY[t]).itemsize


def ply_mesh(spark: SparkSession, path: str) -> DataFrame:
    """(path, genere 'v' or 'f', n from 0, xyz, vertici) of .ply files, text or binary of either byte order."""
    return parsed(files(spark, path, "*.ply"), _ply, "genere string, n int, xyz array<double>, vertici array<int>")


# Rasters


def tiff_header(content: bytes) -> dict:
    """Tags of the first image, and its georeference (x0, y0, sx, sy): the corner of the first cell and the cell size."""
    o = {b"II": "<", b"MM": ">"}[content[:2]]
    magic, at = struct.unpack_from(o + "HI", content, 2)
    if magic != 42:
        raise ValueError("not a classic TIFF")
    sizes = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
    tags: dict[int, tuple | bytes] = {}
    (n,) = struct.unpack_from(o + "H", content, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(o + "HHI", content, at + 2 + 12 * k)
        if kind not in sizes:
            continue
        fmt = o + sizes[kind] * count
        size = struct.calcsize(fmt)
        pos = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(o + "I", content, at + 2 + 12 * k + 8)[0]
        tags[tag] = content[pos : pos + count] if kind == 2 else struct.unpack_from(fmt, content, pos)
    out = {"order": o, "tags": tags, "cols": tags[256][0], "rows": tags[257][0], "x0": 0.0, "y0": 0.0, "sx": 1.0, "sy": 1.0}
    if 34264 in tags:
        m = tags[34264]
        if abs(m[1]) > 1e-12 or abs(m[4]) > 1e-12:
            raise ValueError("rotated raster")
        out |= {"sx": m[0], "sy": -m[5], "x0": m[3], "y0": m[7]}
    elif 33550 in tags and 33922 in tags:
        s, t = tags[33550], tags[33922]
        out |= {"sx": s[0], "sy": s[1], "x0": t[3] - t[0] * s[0], "y0": t[4] + t[1] * s[1]}
    keys = tags.get(34735, ())
    if any(keys[i : i + 4] == (1025, 0, 1, 2) for i in range(4, len(keys), 4)):  # the tie point is a cell's middle
        out["x0"] -= out["sx"] / 2
        out["y0"] += out["sy"] / 2
    nodata = tags.get(42113)
    out["nodata"] = float(nodata.split(b"\0")[0]) if nodata else None
    return out


def tiff_grid(content: bytes) -> tuple[dict, np.ndarray]:
    """Header and first band as doubles, void cells NaN (declared value, int16 limits, below -1e30)."""
    import zlib

    h = tiff_header(content)
    t, o = h["tags"], h["order"]
    bits, fmt, comp = t[258][0], t.get(339, (1,))[0], t.get(259, (1,))[0]
    dt = np.dtype(o + {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}[bits, fmt])
    bands = t.get(277, (1,))[0]
    if comp not in (1, 8, 32946) or t.get(317, (1,))[0] != 1:
        raise ValueError("compression is not supported")
    grid = np.full((h["rows"], h["cols"]), np.nan)
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (h["cols"], t.get(278, (h["rows"],))[0])
    offs, cnts = (t[324], t[325]) if tiled else (t[273], t[279])
    across = -(-h["cols"] // tw)
    for i, (at, n) in enumerate(zip(offs, cnts)):
        raw = content[at : at + n]
        raw = zlib.decompress(raw) if comp != 1 else raw
        r, c = (i // across) * th, (i % across) * tw
        a = np.frombuffer(raw, dt)
        a = a[: len(a) // (tw * bands) * tw * bands].reshape(-1, tw, bands)[:, :, 0].astype(float)
        a = a[: h["rows"] - r, : h["cols"] - c]
        grid[r : r + a.shape[0], c : c + a.shape[1]] = a
    if dt.kind == "i" and bits == 16:
        grid[(grid == -32768) | (grid == 32767)] = np.nan
    if h["nodata"] is not None:
        grid[np.isclose(grid, h["nodata"])] = np.nan
    grid[grid < -1e30] = np.nan
    return h, grid


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """One row a GeoTIFF: size, corner, cell size, nodata."""
    def parse(content: bytes) -> Iterator[tuple]:
        h = tiff_header(content)
        yield h["rows"], h["cols"], h["x0"], h["y0"], h["sx"], h["sy"], h["nodata"]

    return parsed(files(spark, path, "*.tif"), parse, "righe int, colonne int, x0 double, y0 double, sx double, sy double, nodata double")


def raster_tiles(spark: SparkSession, path: str, side: int = 256, cell: float | None = None) -> DataFrame:
    """(path, tr, tc, x0, y0, sx, sy, righe, colonne, z): tiles of the first band, z row by row, null where void.

    With ``cell`` the raster is read reduced: every k-th cell, k the whole number of cells that it holds.
    """
    def parse(content: bytes) -> Iterator[tuple]:
        h, g = tiff_grid(content)
        k = max(1, int(cell / h["sx"] + 1e-9)) if cell else 1
        g, sx, sy = g[k // 2 :: k, k // 2 :: k], h["sx"] * k, h["sy"] * k
        for r in range(0, g.shape[0], side):
            for c in range(0, g.shape[1], side):
                p = g[r : r + side, c : c + side]
                yield r // side, c // side, h["x0"] + c * sx, h["y0"] - r * sy, sx, sy, p.shape[0], p.shape[1], [None if v != v else v for v in p.ravel().tolist()]

    return parsed(files(spark, path, "*.tif"), parse, "tr int, tc int, x0 double, y0 double, sx double, sy double, righe int, colonne int, z array<double>")


def sample_tiles(tiles: DataFrame, points: DataFrame, side: int = 256) -> DataFrame:
    """(id, path, z): bilinear height of points in each tiled raster that holds them, over the valid ones of the four cells around.

    ``points``: (id, x, y). Points meet the rasters by equality of a coarse cell as wide as the widest raster, which
    each raster touches at most four of, then by extent; the four cells by equality of raster and tile, clamped at the
    edges. Weights of void cells go to the others; a point with four void cells, or off a raster, has no height in it.
    """
    h = tiles.groupBy("path").agg(F.min("x0").alias("ox"), F.max("y0").alias("oy"), F.first("sx").alias("sx"), F.first("sy").alias("sy"), F.max(F.col("tc") * side + F.col("colonne")).alias("nc"), F.max(F.col("tr") * side + F.col("righe")).alias("nr"))
    h = cut(h)
    wide = h.agg(F.max(F.greatest(F.col("sx") * F.col("nc"), F.col("sy") * F.col("nr")))).first()[0] or 1.0
    cell = lambda c: F.floor(c / wide)
    x1, y0 = F.col("ox") + F.col("sx") * F.col("nc"), F.col("oy") - F.col("sy") * F.col("nr")
    h = h.withColumn("bx", F.explode(F.sequence(cell(F.col("ox")), cell(x1)))).withColumn("by", F.explode(F.sequence(cell(y0), cell(F.col("oy")))))
    p = points.where("x is not null and y is not null").withColumn("bx", cell(F.col("x"))).withColumn("by", cell(F.col("y"))).join(h, ["bx", "by"])
    u, v = (F.col("x") - F.col("ox")) / F.col("sx") - 0.5, (F.col("oy") - F.col("y")) / F.col("sy") - 0.5
    p = p.withColumn("u", u).withColumn("v", v).where("u >= -0.5 and v >= -0.5 and u <= nc - 0.5 and v <= nr - 0.5")
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    p = p.select("id", "path", "u", "v", "nc", "nr", corner.alias("k"))
    c, r = F.greatest(F.lit(0), F.least(F.col("nc") - 1, F.floor("u") + F.col("k.i"))), F.greatest(F.lit(0), F.least(F.col("nr") - 1, F.floor("v") + F.col("k.j")))
    fu, fv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    w = F.when(F.col("k.i") == 1, fu).otherwise(1 - fu) * F.when(F.col("k.j") == 1, fv).otherwise(1 - fv)
    p = p.select("id", "path", c.alias("c"), r.alias("r"), w.alias("w")).withColumn("tr", F.floor(F.col("r") / side).cast("int")).withColumn("tc", F.floor(F.col("c") / side).cast("int"))
    j = p.join(tiles.select("path", "tr", "tc", "colonne", "z"), ["path", "tr", "tc"])
    z = F.element_at("z", ((F.col("r") - F.col("tr") * side) * F.col("colonne") + (F.col("c") - F.col("tc") * side) + 1).cast("int"))
    g = j.withColumn("zz", z).where("zz is not null").groupBy("id", "path").agg(F.sum(F.col("zz") * (F.col("w") + 1e-12)).alias("s"), F.sum(F.col("w") + 1e-12).alias("w"))
    return g.select("id", "path", (F.col("s") / F.col("w")).alias("z"))


# Inventory


#: Extension -> kind of file (fixed values).
KINDS = {"shp": "vettoriale", "gpkg": "vettoriale", "geojson": "vettoriale", "dxf": "disegno", "csv": "tabella", "txt": "tabella", "xlsx": "tabella", "ods": "tabella", "dbf": "tabella", "sqlite": "tabella", "tif": "raster", "tiff": "raster", "obj": "modello", "ply": "modello", "jpg": "immagine", "jpeg": "immagine", "png": "immagine", "zip": "archivio", "pdf": "documento"}
COMPANIONS = ("shx", "prj", "cpg", "tfw", "mtl", "qix", "sbn", "sbx")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, cartella, nome, radice, ext, genere, byte, membro): files and the members of zip archives, up to four deep.

    Companions go with their main file and copies ('- Copia', '(2)') are left out. Contents are read of zips only.
    """
    def members(content: bytes, prefix: str = "", depth: int = 0) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if i.is_dir() or ".." in i.filename.split("/"):
                    continue
                yield f"{prefix}{i.filename}", i.file_size
                if i.filename.lower().endswith(".zip") and depth < 3:
                    yield from members(z.read(i), f"{prefix}{i.filename}!", depth + 1)

    plain = files(spark, path).select("path", F.col("length").alias("byte"), F.lit(None).cast("string").alias("membro"))
    zips = parsed(files(spark, path, "*.zip"), members, "membro string, byte bigint").select("path", "byte", "membro")
    name = F.element_at(F.split(F.coalesce("membro", "path"), "/"), -1)
    both = plain.unionByName(zips).withColumn("nome", name).withColumn("ext", F.lower(F.regexp_extract("nome", r"\.([^.]+)$", 1))).withColumn("radice", F.regexp_replace("nome", r"\.[^.]+$", ""))
    kind = F.create_map([F.lit(x) for k, v in KINDS.items() for x in (k, v)])
    return both.withColumn("cartella", F.regexp_replace("path", "/[^/]*$", "")).withColumn("genere", F.coalesce(F.try_element_at(kind, "ext"), F.lit("altro"))).where(~F.col("ext").isin(*COMPANIONS) & ~F.col("radice").rlike(r"( - Copia|\([0-9]+\))$"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte, sha256) of all files, for change detection."""
    return files(spark, path).select("path", F.col("length").alias("byte"), F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, stato): new, missing or changed files between two ``fingerprints``."""
    from ..operators.relational import changed

    return changed(before, after, "path", "sha256")
