import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from conftest import rows
from decumano.operators import sheets as SH
from decumano.sources import binary as B
from decumano.sources import sinks, tables


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "uno & due", 2.5), (2, None, None)], "us int, nota string, z double")
    sinks.write_workbook({"Schede": df, "Altro": df.limit(1)}, str(tmp_path / "a.xlsx"))
    got = {(r.foglio, r.riga, r.colonna): r.valore for r in B.workbook_cells(spark, str(tmp_path)).collect()}
    assert got["Schede", 1, 2] == "nota" and got["Schede", 2, 2] == "uno & due" and got["Schede", 2, 3] == "2.5" and ("Schede", 3, 2) not in got and got["Altro", 2, 1] == "1"
    with pytest.raises(ValueError):
        sinks.write_workbook({"S": df}, str(tmp_path / "b.xlsx"), most=1)


def test_sqlite_and_write_back(spark, tmp_path):
    p = str(tmp_path / "a.sqlite")
    with sqlite3.connect(p) as c:
        c.execute("create table us_table (us integer, nota text, img blob, t blob)")
        c.executemany("insert into us_table values (?, ?, ?, ?)", [(i, f"n{i}", b"\x00\xff", "testo".encode()) for i in range(1, 51)])
        c.execute("create table gpkg_contents (x)")
    assert tables.sqlite_tables(p) == ["us_table"]
    tables.register(spark)
    df = spark.read.format("sqlite-table").option("table", "us_table").option("partitions", "3").load(p)
    assert df.columns == ["us", "nota", "t"] and df.count() == 50 and df.where("us = '7'").first().t == "testo"
    ch = spark.createDataFrame([(7, "nota", "nuova"), (99, "nota", "x")], "chiave int, colonna string, valore string")
    assert sinks.write_back_sqlite(ch, p, "us_table", "us") == 1
    out = sinks.apply_changes(df.select("us", "nota"), ch.selectExpr("string(chiave) chiave", "colonna", "valore"), "us", ["nota"])
    assert out.where("us = '7'").first().nota == "nuova" and out.where("us = '99'").first().nota == "x" and out.count() == 51


def test_csv_sniffing_points_and_wkt(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("EST;NORD;Quota;Città\n1,5;2;3;è\n;2;3;x\n".encode("cp1252"))
    assert tables.sniff((tmp_path / "a.csv").read_bytes()) == (";", "windows-1252")
    df = tables.points_from_columns(tables.read_table(spark, str(tmp_path / "a.csv")))
    got = df.collect()
    assert got[0]["Città"] == "è" and tuple(got[0].geom) == (1.5, 2.0, 3.0) and got[1].geom is None
    w = spark.createDataFrame([("POLYGON ((0 0, 1 0, 1 1), (0.2 0.2, 0.3 0.2, 0.3 0.3))",), ("POINT Z (1 2 3)",)], "w string").select(tables.wkt_parts("w").alias("p")).collect()
    assert len(w[0].p) == 2 and tuple(w[1].p[0][0]) == (1.0, 2.0, 3.0)


def test_vector_files(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<I4d2I1I", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    rec = struct.pack(">II", 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + rec)
    s = B.shapes(spark, str(tmp_path)).first()
    assert s.tipo == "Polygon" and len(s.parti[0]) == 4 and s.parti[0][1].x == 1.0
    field = b"NOME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 24, 1, 1, 2, 65, 7) + b"\0" * 20 + field + b"\r" + b" fossa " + b"*muro  ")
    d = B.dbf_records(spark, str(tmp_path)).collect()
    assert len(d) == 1 and d[0].campi == {"NOME": "fossa"}
    (tmp_path / "a.dxf").write_text("0\nSECTION\n2\nENTITIES\n0\nLWPOLYLINE\n8\nUS12\n70\n1\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n1\n0\nTEXT\n8\nT\n10\n5\n20\n6\n1\nUS 12\n0\nENDSEC\n0\nEOF\n")
    e = B.dxf_entities(spark, str(tmp_path)).orderBy("numero").collect()
    assert [(x.tipo, x.gruppo, x.testo) for x in e] == [("Polygon", "US#", None), ("Text", "T", "US 12")]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"us": 5}}]}))
    g = B.geojson(spark, str(tmp_path)).first()
    assert g.tipo == "Point" and g.coordinate == "[1,2]" and g.proprieta == {"us": "5"}
    point = b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BI3d", 1, 1001, 1, 2, 3)
    assert B.gpkg_geometry(point) == ("Point", [[(1.0, 2.0, 3.0)]])
    poly = struct.pack("<BII", 1, 6, 1) + struct.pack("<BIII", 1, 3, 1, 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    kind, parts, _ = B.wkb(poly)
    assert kind == "MultiPolygon" and len(parts[0]) == 4


def test_meshes(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n")
    v, f = B.obj_mesh(spark, str(tmp_path))
    assert v.count() == 4 and rows(f.select("a", "b", "c")) == [(1, 2, 3), (1, 2, 3), (1, 3, 4)]
    head = "ply\nformat {}\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii 1.0") + "0 0 0\n1 0 0\n0 1 5\n3 0 1 2\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_big_endian 1.0").encode() + struct.pack(">9f", 0, 0, 0, 1, 0, 0, 0, 1, 5) + struct.pack(">B3i", 3, 0, 1, 2))
    p = B.ply_mesh(spark, str(tmp_path)).collect()
    assert len(p) == 8 and [x.vertici for x in p if x.genere == "f"] == [[0, 1, 2]] * 2 and max(x.xyz[2] for x in p if x.xyz) == 5.0


def tiff(grid, x0, y0, cell, nodata):
    data = grid.astype("<f4").tobytes()
    nod = str(nodata).encode() + b"\0"
    entries, extra = [], b""
    n = 12
    base = 8 + 2 + 12 * n + 4

    def put(tag, kind, count, payload):
        nonlocal extra
        if len(payload) <= 4:
            entries.append(struct.pack("<HHI", tag, kind, count) + payload.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, kind, count, base + len(extra)))
            extra += payload + b"\0" * (len(payload) % 2)

    put(256, 3, 1, struct.pack("<H", grid.shape[1]))
    put(257, 3, 1, struct.pack("<H", grid.shape[0]))
    put(258, 3, 1, struct.pack("<H", 32))
    put(259, 3, 1, struct.pack("<H", 1))
    put(277, 3, 1, struct.pack("<H", 1))
    put(278, 3, 1, struct.pack("<H", grid.shape[0]))
    put(339, 3, 1, struct.pack("<H", 3))
    put(33550, 12, 3, struct.pack("<3d", cell, cell, 0))
    put(33922, 12, 6, struct.pack("<6d", 0, 0, 0, x0, y0, 0))
    put(42113, 2, len(nod), nod)
    at = len(entries)
    put(279, 4, 1, struct.pack("<I", len(data)))
    put(273, 4, 1, struct.pack("<I", base + len(extra)))
    assert at == 10
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", n) + b"".join(entries) + b"\0" * 4 + extra + data


def test_raster_plane_with_a_hole(spark, tmp_path):
    xs = 1000 + 2 * (np.arange(12) + 0.5)
    g = np.tile(50 + 0.1 * (xs - 1000), (12, 1))
    g[0, 0] = -9999
    (tmp_path / "dem.tif").write_bytes(tiff(g, 1000.0, 2020.0, 2.0, -9999))
    h = B.rasters(spark, str(tmp_path)).first()
    assert (h.righe, h.colonne, h.x0, h.y0, h.sx) == (12, 12, 1000.0, 2020.0, 2.0)
    t = B.raster_tiles(spark, str(tmp_path), side=5)
    assert t.count() == 9
    pts = spark.createDataFrame([(1, 1011.0, 2010.0), (2, 1012.0, 2010.0), (3, 1001.0, 2019.0), (4, 5000.0, 0.0), (5, 1002.0, 2018.0)], "id int, x double, y double")
    z = {r.id: r.z for r in B.sample_tiles(t, pts, side=5).collect()}
    assert z[1] == pytest.approx(51.1, abs=1e-4) and z[2] == pytest.approx(51.2, abs=1e-4) and 4 not in z and z[5] == pytest.approx(50.233, abs=1e-2)
    assert B.raster_tiles(spark, str(tmp_path), cell=4.0).first().sx == 4.0
    # A second raster in the folder, twice as coarse, elsewhere but for a strip: heights are not mixed.
    (tmp_path / "due.tif").write_bytes(tiff(np.full((12, 12), 7.0), 1020.0, 2020.0, 4.0, -9999))
    both = {(r.id, r.path.rsplit("/", 1)[-1]): r.z for r in B.sample_tiles(B.raster_tiles(spark, str(tmp_path), side=5), spark.createDataFrame([(1, 1011.0, 2010.0), (6, 1022.0, 2010.0), (7, 1060.0, 2000.0)], "id int, x double, y double"), side=5).collect()}
    assert both == {(1, "dem.tif"): pytest.approx(51.1, abs=1e-4), (6, "dem.tif"): pytest.approx(52.2, abs=1e-4), (6, "due.tif"): pytest.approx(7.0), (7, "due.tif"): pytest.approx(7.0)}


def test_a_late_byte_decides_the_encoding(spark, tmp_path):
    from decumano.sources import tables

    (tmp_path / "t.csv").write_bytes(b"a,b\n" + b"uno,due\n" * 20_000 + "perché,sì\n".encode("cp1252"))
    d = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert d.count() == 20_001 and d.where("b = 'sì' and a = 'perché'").count() == 1


def test_inventory_fingerprints_project_and_cache(spark, tmp_path):
    (tmp_path / "f").mkdir()
    with zipfile.ZipFile(tmp_path / "f" / "a.zip", "w") as z:
        z.writestr("dem/uno.tif", b"x")
        z.writestr("../male.csv", b"x")
    (tmp_path / "f" / "b.csv").write_text("a,b")
    (tmp_path / "f" / "b - Copia.csv").write_text("a,b")
    (tmp_path / "f" / "c.prj").write_text("x")
    inv = B.inventory(spark, str(tmp_path / "f"))
    assert sorted((r.nome, r.genere) for r in inv.collect()) == [("a.zip", "archivio"), ("b.csv", "tabella"), ("uno.tif", "raster")]
    now = B.fingerprints(spark, str(tmp_path / "f"))
    before = spark.createDataFrame(now.collect(), now.schema)
    assert before.count() == 4
    (tmp_path / "f" / "b.csv").write_text("a,c")
    assert [r.stato for r in B.changed_files(before, B.fingerprints(spark, str(tmp_path / "f"))).collect()] == ["cambiata"]
    for k in (3, 4):
        sinks.save_project({"t": spark.range(k)}, str(tmp_path / "p"))
    assert sinks.open_project(spark, str(tmp_path / "p"))["t"].count() == 4
    made = []
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path), "k1", lambda: made.append(1) or spark.range(2)).count() == 2
    assert made == [1]


def test_drawings_model_and_payload(spark, tmp_path):
    sq = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]
    p = spark.createDataFrame([(1, 1, "#ff0000", sq), (2, 1, None, [[{"x": v["x"] + 5, "y": v["y"]} for v in sq[0]]]), (3, None, None, None)], "unita int, fase int, colore string, anelli array<array<struct<x: double, y: double>>>")
    names = sinks.write_texts(sinks.svg_lines(p), "fase", "svg", str(tmp_path), ".svg")
    assert open(names[0]).read().count("<path") == 2
    assert sinks.dxf_text(p).first().dxf.count("VERTEX") == 6
    q = sinks.payload(p).orderBy("unita").collect()
    assert [r.uguale for r in q] == [1, 1] and q[0].q == [[0, 0, 1000, 0, 1000, 1000]]
    m = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 1.0, "z": 1.0}], [[0, 1, 2]])], "unita int, vertici array<struct<x: double, y: double, z: double>>, facce array<array<int>>")
    assert sinks.write_glb(m, str(tmp_path / "a.glb")) == 1
    raw = (tmp_path / "a.glb").read_bytes()
    assert raw[:4] == b"glTF" and struct.unpack("<I", raw[8:12])[0] == len(raw)


def cells(spark, sheet, grid):
    return spark.createDataFrame([(sheet, r, c, v) for r, row in enumerate(grid, 1) for c, v in enumerate(row, 1) if v is not None], "foglio string, riga int, colonna int, valore string")


def test_sheet_with_titles_totals_and_repeated_header(spark):
    c = cells(spark, "s", [["Scavo di prova", None, None], ["US", "Tipo", "Quota"], ["1", "strato", "inf"], ["US", "Tipo", "Quota"], ["2", "taglio", "5,1"], ["Totale", None, "2"], ["Le quote sono in metri", None, None]])
    got = rows(SH.records(c).select("riga", "campo", "valore"))
    assert got == sorted([(3, "US", "1"), (3, "Tipo", "strato"), (3, "Quota", "inf"), (5, "US", "2"), (5, "Tipo", "taglio"), (5, "Quota", "5,1")], key=repr)
    assert SH.report(c).first().scartate == 5


def test_stacked_transposed_forms_and_matrix(spark):
    c = cells(spark, "s", [["a", "b"], ["1", "2"], [None, None], ["c", "d"], ["3", "4"]])
    assert {r.riga: r.tabella for r in SH.segments(c).collect()} == {1: 1, 2: 1, 4: 2, 5: 2}
    two = cells(spark, "s", [["Quote", None, "Peso"], ["max", "min", "g"], ["1", "2", "3"]])
    h = spark.createDataFrame([("s", 2)], "foglio string, testata int")
    assert [r.nome for r in SH.column_names(two, h, 2).orderBy("colonna").collect()] == ["Quote max", "Quote min", "Peso g"]
    t = SH.transposed(cells(spark, "s", [["US", "1", "2"], ["Tipo", "strato", "taglio"]]))
    assert rows(t.select("record", "campo", "valore")) == [(1, "Tipo", "strato"), (1, "US", "1"), (2, "Tipo", "taglio"), (2, "US", "2")]
    f = SH.label_blocks(cells(spark, "s", [["US:", "1", "Tipo", "strato"], ["Nota", "x", None, None], ["US", "2", "Tipo", "taglio"]]), "us")
    assert rows(f.select("record", "campo", "valore")) == [(1, "Nota", "x"), (1, "Tipo", "strato"), (1, "US", "1"), (2, "Tipo", "taglio"), (2, "US", "2")]
    m = SH.relation_matrix(cells(spark, "s", [[None, "1", "2", "3"], ["1", None, ">", "="], ["2", "<", None, "x"], ["3", "=", None, None]]))
    assert rows(m.select("a", "rel", "b")) == [(1, "copre", 2), (1, "uguale a", 3), (2, "copre", 3)]
