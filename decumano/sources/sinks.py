"""Where results go: projects, workbooks, drawings, models, payloads, and back to their sources.

Tables are written by the executors. Drawings, workbooks and models are single files of bounded size: their
lines are built in the engine, and the driver only joins them.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import struct
import uuid
import zipfile
from collections.abc import Callable, Mapping, Sequence
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_project(tables: Mapping[str, DataFrame], path: str) -> None:
    """A project: one Parquet table a name. Written beside the old one, then put in its place."""
    tmp = f"{path}.{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{tmp}/{name}")
    old = f"{path}.old"
    if os.path.exists(path):
        os.rename(path, old)
    os.rename(tmp, path)
    shutil.rmtree(old, ignore_errors=True)


def open_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in sorted(os.listdir(path)) if not n.startswith((".", "_"))}


def write_workbook(sheets: Mapping[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """An .xlsx file of a few sheets; a sheet holds at most ``most`` rows, beyond that the call is refused."""
    def cell(v, ref: str) -> str:
        if v is None:
            return ""
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    def letters(k: int) -> str:
        out = ""
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    x = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", x + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", x + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", x + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", x + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            df = sheets[n]
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"sheet {n} has more than {most} rows")
            body = [list(df.columns), *map(list, rows)]
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write((x + f'<worksheet xmlns="{main}"><sheetData>').encode())
                for r, row in enumerate(body, 1):
                    f.write((f'<row r="{r}">' + "".join(cell(v, f"{letters(c)}{r}") for c, v in enumerate(row, 1)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")


def svg_lines(plans: DataFrame, scale: float = 20.0) -> DataFrame:
    """(fase, svg): one drawing a phase; ``plans``: (unita, fase, colore, anelli). Paths are built in the engine."""
    pt = lambda p: F.format_string("%.2f,%.2f", p["x"] * scale, -p["y"] * scale)
    ring = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, pt), " L"), F.lit("Z"))
    path = F.concat(F.lit('<path id="u'), F.col("unita").cast("string"), F.lit('" fill="'), F.coalesce("colore", F.lit("#cccccc")), F.lit('" fill-rule="evenodd" d="'), F.array_join(F.transform("anelli", ring), " "), F.lit('"/>'))
    g = plans.where("anelli is not null").select("fase", "unita", path.alias("p")).groupBy("fase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unita", "p"))), lambda s: s["p"]), "\n").alias("b"))
    return g.select("fase", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), "b", F.lit("\n</svg>")).alias("svg"))


def dxf_text(plans: DataFrame) -> DataFrame:
    """(fase, dxf): entities of a drawing a phase (R12 polylines on layer FASE_n), to be put between header and end."""
    vert = lambda p: F.format_string("0\nVERTEX\n8\n%s\n10\n%.3f\n20\n%.3f\n", F.col("strato"), p["x"], p["y"])
    ring = lambda r: F.concat(F.lit("0\nPOLYLINE\n8\n"), F.col("strato"), F.lit("\n66\n1\n70\n1\n"), F.array_join(F.transform(r, vert), ""), F.lit("0\nSEQEND\n"))
    d = plans.where("anelli is not null").withColumn("strato", F.concat(F.lit("FASE_"), F.coalesce(F.col("fase").cast("string"), F.lit("0"))))
    e = d.select("fase", "unita", F.array_join(F.transform("anelli", ring), "").alias("e"))
    g = e.groupBy("fase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unita", "e"))), lambda s: s["e"]), "").alias("b"))
    return g.select("fase", F.concat(F.lit("0\nSECTION\n2\nENTITIES\n"), "b", F.lit("0\nENDSEC\n0\nEOF\n")).alias("dxf"))


def write_texts(df: DataFrame, key: str, text: str, folder: str, suffix: str) -> list[str]:
    """One text file a row; rows come to the driver one partition at a time."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in df.select(key, text).toLocalIterator():
        name = os.path.join(folder, f"{r[0] if r[0] is not None else 'senza'}{suffix}")
        with open(name, "w", encoding="utf-8") as f:
            f.write(r[1])
        out.append(name)
    return sorted(out)


def write_glb(meshes: DataFrame, path: str) -> int:
    """A binary glTF with one node a unit; ``meshes``: (unita, vertici array<(x, y, z)>, facce array<array<int>>)."""
    views, accessors, mesh, nodes, blob = [], [], [], [], bytearray()

    def add(a: np.ndarray, target: int) -> int:
        while len(blob) % 4:
            blob.append(0)
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": a.nbytes, "target": target})
        blob.extend(a.tobytes())
        return len(views) - 1

    for r in meshes.select("unita", "vertici", "facce").orderBy("unita").toLocalIterator():
        v = np.array([[p["x"], p["z"], -p["y"]] for p in r["vertici"]], "<f4")
        f = np.array(r["facce"], "<u4").ravel()
        if not len(v) or not len(f):
            continue
        accessors.append({"bufferView": add(v, 34962), "componentType": 5126, "count": len(v), "type": "VEC3", "min": v.min(0).tolist(), "max": v.max(0).tolist()})
        accessors.append({"bufferView": add(f, 34963), "componentType": 5125, "count": len(f), "type": "SCALAR"})
        mesh.append({"primitives": [{"attributes": {"POSITION": len(accessors) - 2}, "indices": len(accessors) - 1}]})
        nodes.append({"mesh": len(mesh) - 1, "name": str(r["unita"])})
    while len(blob) % 4:
        blob.append(0)
    doc = json.dumps({"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(nodes)))}], "nodes": nodes, "meshes": mesh, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(blob)}]}).encode()
    doc += b" " * (-len(doc) % 4)
    with open(path, "wb") as f:
        f.write(struct.pack("<III", 0x46546C67, 2, 28 + len(doc) + len(blob)))
        f.write(struct.pack("<II", len(doc), 0x4E4F534A) + doc + struct.pack("<II", len(blob), 0x004E4942) + bytes(blob))
    return len(nodes)


#: Steps of quantisation in metres; the first that keeps the extent below 65000 steps is taken (fixed values).
STEPS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 1.0)


def payload(plans: DataFrame) -> DataFrame:
    """(unita, passo, x0, y0, q, impronta, uguale): quantised outlines; units of one outline share ``uguale``."""
    p = F.flatten("anelli")
    b = plans.where("anelli is not null").select("unita", "anelli", F.array_min(F.transform(p, lambda v: v["x"])).alias("x0"), F.array_min(F.transform(p, lambda v: v["y"])).alias("y0"), F.array_max(F.transform(p, lambda v: v["x"])).alias("x1"), F.array_max(F.transform(p, lambda v: v["y"])).alias("y1"))
    ext = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    step = F.coalesce(*(F.when(ext / s < 65000, F.lit(s)) for s in STEPS[:-1]), F.lit(STEPS[-1]))
    q = F.transform("anelli", lambda r: F.flatten(F.transform(r, lambda v: F.array(F.round((v["x"] - F.col("x0")) / F.col("passo")).cast("int"), F.round((v["y"] - F.col("y0")) / F.col("passo")).cast("int")))))
    out = b.withColumn("passo", step).withColumn("q", q).withColumn("impronta", F.sha2(F.to_json("q"), 256))
    first = out.groupBy("impronta").agg(F.min("unita").alias("uguale"))
    return out.join(first, "impronta").select("unita", "passo", "x0", "y0", "q", "impronta", "uguale")


def documentation(links: DataFrame) -> DataFrame:
    return links.select("unita", "genere", "nome", "path", "motivo").orderBy("unita", F.lower("path"))


def write_back_sqlite(changes: DataFrame, path: str, table: str, key: str) -> int:
    """Cell changes (chiave, colonna, valore) applied to a table of a SQLite file, after a backup copy."""
    shutil.copy2(path, path + ".bak")
    n = 0
    with sqlite3.connect(path) as c:
        known = {r[1] for r in c.execute(f'pragma table_info("{table}")')}
        for r in changes.select("chiave", "colonna", "valore").orderBy("chiave", "colonna").toLocalIterator():
            if r["colonna"] not in known:
                raise ValueError(f"no column {r['colonna']}")
            n += c.execute(f'update "{table}" set "{r["colonna"]}" = ? where "{key}" = ?', (r["valore"], r["chiave"])).rowcount
    return n


def apply_changes(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], inverse: Mapping[str, Callable] | None = None) -> DataFrame:
    """A source table with its cell changes (chiave, colonna, valore): updated, new keys appended; as one join."""
    inverse = inverse or {}
    w = changes.groupBy(F.col("chiave").alias("__k")).agg(*(F.max(F.when(F.col("colonna") == c, F.struct(F.lit(1).alias("s"), F.col("valore").alias("v")))).alias(f"__{c}") for c in columns))
    j = df.join(w, F.col(key) == F.col("__k"), "full_outer")
    value = lambda c: inverse.get(c, lambda v: v)(F.col(f"__{c}.v"))
    return j.select(*(F.coalesce(F.col(key), F.col("__k")).alias(key) if c == key else F.when(F.col(f"__{c}.s") == 1, value(c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def cached(spark: SparkSession, folder: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A Parquet table kept by fingerprint: made once, read afterwards. A table cut off half-way is made again."""
    path = f"{folder}/{mark}"
    if not os.path.exists(f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
