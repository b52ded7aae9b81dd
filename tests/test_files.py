from datetime import datetime

from conftest import rows
from decumano.operators import files as D


def test_formats_versions_and_hypotheses(spark):
    f = spark.createDataFrame([("/a/p.csv", "/a", "p", "csv", "tabella", 5), ("/a/p.xlsx", "/a", "P", "xlsx", "tabella", 9), ("/a/p (2).xlsx", "/a", "p (2)", "xlsx", "tabella", 9), ("/a/p - Copia.xlsx", "/a", "p - Copia", "xlsx", "tabella", 8), ("/a/run_1/q.csv", "/a/run_1", "q", "csv", "tabella", 1)], "path string, cartella string, radice string, ext string, genere string, byte bigint")
    # The copy of the same size goes, the one of another size is another file.
    assert rows(D.best_formats(f).select("path")) == [("/a/p (2).xlsx",), ("/a/p - Copia.xlsx",)]
    v = spark.createDataFrame([("/x/s.csv", "s", "csv", 3, datetime(2024, 1, 1, 10, 5)), ("/x/y/s.csv", "s", "csv", 9, datetime(2024, 1, 1, 10, 50)), ("/s_old.csv", "s_old", "csv", 1, datetime(2023, 1, 1))], "path string, radice string, ext string, byte bigint, modificato timestamp")
    assert rows(D.latest_versions(v).select("path")) == [("/x/s.csv",)]
    h = spark.createDataFrame([("d", "r", 0.9), ("d", "r", 0.4), ("e", "r", 0.4), ("d", "s", 0.5)], "insieme string, ruolo string, punteggio double")
    assert rows(D.without_weak(h)) == [("d", "r", 0.9), ("d", "s", 0.5), ("e", "r", 0.4)]


def test_paths_and_images(spark):
    f = spark.createDataFrame([("/arch/foto/US 1005 nord.jpg", "/arch/foto", "US 1005 nord.jpg"), ("/arch/US_12/IMG_0012.jpg", "/arch/US_12", "IMG_0012.jpg"), ("/arch/x/1005-12.jpg", "/arch/x", "1005-12.jpg"), ("/arch/x/2024-10-05.jpg", "/arch/x", "2024-10-05.jpg"), ("/b/x/2024-10-05.jpg", "/b/x", "2024-10-05.jpg")], "path string, cartella string, nome string")
    r = spark.createDataFrame([(1, "/arch/x/1005-12.jpg"), (2, "foto\\us 1005 nord.jpg"), (3, "altrove/IMG_0012.JPG"), (4, "2024-10-05.jpg"), (5, None)], "id int, file string")
    assert rows(D.resolve_paths(r, f, "id", "file", ["/arch"])) == [(1, "/arch/x/1005-12.jpg", 0), (2, "/arch/foto/US 1005 nord.jpg", 1), (3, "/arch/US_12/IMG_0012.jpg", 2)]
    u = spark.createDataFrame([(1005,), (12,), (5,)], "unita bigint")
    assert rows(D.images_of_units(f, u)) == [("/arch/US_12/IMG_0012.jpg", 12, 2), ("/arch/foto/US 1005 nord.jpg", 1005, 1), ("/arch/x/1005-12.jpg", 1005, 3), ("/arch/x/1005-12.jpg", 12, 3)]


def test_raster_cells(spark):
    t = spark.createDataFrame([("p", 0, 0, 10.0, 20.0, 1.0, 1.0, 2, 2, [1.0, None, 3.0, 4.0])], "path string, tr int, tc int, x0 double, y0 double, sx double, sy double, righe int, colonne int, z array<double>")
    c = D.cells_of(t).select("cx", "cy", "x", "y", "z")
    assert rows(c) == [(0, 0, 10.5, 19.5, 1.0), (0, 1, 10.5, 18.5, 3.0), (1, 1, 11.5, 18.5, 4.0)]
    low = spark.createDataFrame([(0, 0, 0.5), (1, 1, 3.99)], "cx bigint, cy bigint, z double")
    assert rows(D.lowered(c, low)) == [(0, 0, 0.5)]
    assert rows(D.combine_rasters(low, spark.createDataFrame([(0, 0, -0.25)], low.schema))) == [(0, 0, 0.25), (1, 1, 3.99)]
    assert rows(D.footprint_runs(c)) == [(0, 0, 0), (1, 0, 1)]
