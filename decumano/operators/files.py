"""Files of an archive: copies and poorer formats left out, paths resolved, images given to units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mask_noise, plain

#: Better formats first (fixed values).
PREFERENCE = ("gpkg", "shp", "geojson", "dxf", "xlsx", "ods", "csv", "txt", "dbf", "tif", "tiff", "jpg", "jpeg", "png", "obj", "ply")
COPY = r"( - copia| - copy| ?\([0-9]+\)|_bcp|_old|_backup)$"
DERIVED = r"(?i)/(run|output|out|tmp|old)_?[^/]*/"


def name_key(c: Column) -> Column:
    """The name that copies and formats of one file share."""
    return F.regexp_replace(plain(c), COPY, "")


def best_formats(files: DataFrame) -> DataFrame:
    """One file a (genere, cartella, name): the best format, then the shallower and earlier path.

    ``files``: (path, cartella, radice, ext, genere, byte). Files of one extension are copies only if their sizes agree.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("ext")), F.lit(0)), F.lit(len(PREFERENCE) + 1))
    order = F.struct(rank.alias("r"), F.size(F.split("path", "/")).alias("d"), F.col("path").alias("p"))
    keyed = files.where(~F.col("path").rlike(DERIVED)).withColumn("__k", name_key(F.col("radice"))).withColumn("__o", order)
    best = keyed.groupBy("genere", "cartella", "__k").agg(F.min("__o").alias("__b"), F.min_by(F.struct("ext", "byte"), "__o").alias("__f"))
    j = keyed.join(best, ["genere", "cartella", "__k"])
    own = F.col("__o") == F.col("__b")
    other = (F.col("ext") == F.col("__f.ext")) & (F.col("byte") != F.col("__f.byte"))
    return j.where(own | other).select(*files.columns)


def latest_versions(files: DataFrame, time: str = "modificato") -> DataFrame:
    """One file a name and extension over all folders: the latest by the hour, then the shallower, then the larger."""
    order = F.struct(F.date_trunc("hour", F.col(time)).alias("t"), (-F.size(F.split("path", "/"))).alias("d"), F.col("byte"), F.col("path"))
    g = files.groupBy(name_key(F.col("radice")).alias("__k"), "ext").agg(F.max_by(F.struct(*files.columns), order).alias("s"))
    return g.select("s.*")


def without_weak(hypotheses: DataFrame, weak: float = 0.45, strong: float = 0.8) -> DataFrame:
    """Hypotheses (insieme, ruolo, punteggio, ...) less the weak ones that have a strong peer."""
    best = hypotheses.groupBy(F.col("insieme").alias("__i"), F.col("ruolo").alias("__r")).agg(F.max("punteggio").alias("__m"))
    j = hypotheses.join(best, F.col("insieme").eqNullSafe(F.col("__i")) & F.col("ruolo").eqNullSafe(F.col("__r")))
    return j.where((F.col("punteggio") >= weak) | (F.col("__m") < strong)).drop("__i", "__r", "__m")


def resolve_paths(rows: DataFrame, files: DataFrame, key: str, wanted: str, bases: Sequence[str] = ()) -> DataFrame:
    """(key, path, livello): where the file that a row names is: as given (0), below a base (1..), else by name only.

    By name only a file counts if it is the only one of that name. Each level is one equi-join.
    """
    norm = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    f = files.select(F.col("path"), norm(F.col("path")).alias("__p"), F.element_at(F.split(norm(F.col("path")), "/"), -1).alias("__n"))
    w = rows.where(F.col(wanted).isNotNull()).select(key, norm(F.col(wanted)).alias("__w")).withColumn("__wn", F.element_at(F.split("__w", "/"), -1))
    tiers = [w.join(f, F.col("__w") == F.col("__p")).select(key, "path", F.lit(0).alias("livello"))]
    for i, b in enumerate(bases, 1):
        tiers.append(w.join(f, F.concat(F.lit(b.rstrip("/").lower() + "/"), F.col("__w")) == F.col("__p")).select(key, "path", F.lit(i).alias("livello")))
    once = f.groupBy("__n").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("__c")).where("__c = 1")
    tiers.append(w.join(once, F.col("__wn") == F.col("__n")).select(key, "path", F.lit(len(bases) + 1).alias("livello")))
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    return every.groupBy(key).agg(F.min_by(F.struct("path", "livello"), F.struct("livello", "path")).alias("s")).select(key, "s.*")


def images_of_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """(path, unita, regola): units that an image shows, by its name and folder.

    1: numbers after 'US', 'USM' or 'unit' in the name; 2: the same in the nearest folder; 3: bare numbers of the name,
    once dates, scales and camera counters are masked. Only numbers of known units count, and only the first rule that
    finds one.
    """
    tagged = lambda c: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(?:usm?|unit)[ _.-]*([0-9]{1,7})"), 1), lambda n: n.cast("bigint"))
    folder = F.element_at(F.split("cartella", "/"), -1)
    bare = F.transform(F.regexp_extract_all(mask_noise(F.col("nome")), F.lit(r"(?:^|[^0-9])([0-9]{1,7})(?![0-9])"), 1), lambda n: n.cast("bigint"))
    by_rule = lambda k, found: F.transform(found, lambda u: F.struct(F.lit(k).alias("regola"), u.alias("unita")))
    every = F.concat(by_rule(1, tagged(F.col("nome"))), by_rule(2, tagged(folder)), by_rule(3, bare))
    cand = files.select("path", F.explode(every).alias("x")).select("path", "x.*").distinct()
    known = cand.join(units.select("unita").distinct(), "unita", "left_semi")
    first = known.groupBy(F.col("path").alias("__p")).agg(F.min("regola").alias("__r"))
    return known.join(first, (F.col("path") == F.col("__p")) & (F.col("regola") == F.col("__r"))).select("path", "unita", "regola")


def combine_rasters(base: DataFrame, correction: DataFrame) -> DataFrame:
    """(cx, cy, z): cells of a base with a correction added where there is one; ``base``, ``correction``: (cx, cy, z)."""
    c = correction.select(F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("z").alias("__z"))
    j = base.join(c, (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y")), "left")
    return j.select("cx", "cy", (F.col("z") + F.coalesce("__z", F.lit(0.0))).alias("z"))


def cells_of(tiles: DataFrame, side: int = 256) -> DataFrame:
    """(path, cx, cy, x, y, z) of the filled cells of raster tiles, x and y in the middle of the cell."""
    t = tiles.select("path", "tr", "tc", "x0", "y0", "sx", "sy", "colonne", F.posexplode("z").alias("k", "z")).where("z is not null")
    r, c = F.floor(F.col("k") / F.col("colonne")), F.col("k") % F.col("colonne")
    return t.select("path", (F.col("tc") * side + c).cast("bigint").alias("cx"), (F.col("tr") * side + r).cast("bigint").alias("cy"), (F.col("x0") + (c + 0.5) * F.col("sx")).alias("x"), (F.col("y0") - (r + 0.5) * F.col("sy")).alias("y"), "z")


def lowered(first: DataFrame, last: DataFrame, least: float = 0.02) -> DataFrame:
    """(cx, cy, dz) of cells that were lowered by more than ``least`` between two surveys of one grid."""
    b = last.select(F.col("cx").alias("__x"), F.col("cy").alias("__y"), F.col("z").alias("__z"))
    return first.join(b, (F.col("cx") == F.col("__x")) & (F.col("cy") == F.col("__y"))).select("cx", "cy", (F.col("z") - F.col("__z")).alias("dz")).where(F.col("dz") > least)


def footprint_runs(cells: DataFrame) -> DataFrame:
    """(cy, da, a): runs of filled cells in each row of a raster (gaps and islands)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("cy").orderBy("cx")
    return cells.select("cx", "cy").distinct().withColumn("g", F.col("cx") - F.row_number().over(w)).groupBy("cy", "g").agg(F.min("cx").alias("da"), F.max("cx").alias("a")).select("cy", "da", "a")
