"""Relational steps of the archive pipeline: renames, lookups, rollups, pivots and ordered steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import blank_to_null, without_sentinels
from ..session import row_numbers


# Projection


def rename_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each canonical name takes the first of its aliases that is there (case and blanks ignored).

    A column that would clash with a canonical name gets the suffix ' (archivio)'.
    """
    by_key = {c.strip().lower(): c for c in df.columns}
    chosen: dict[str, str] = {}
    for name, options in aliases.items():
        hit = next((by_key[o.strip().lower()] for o in (name, *options) if o.strip().lower() in by_key), None)
        if hit is not None and hit not in chosen:
            chosen[hit] = name
    taken = {n.lower() for n in chosen.values()}
    names = [chosen[c] if c in chosen else f"{c} (archivio)" if c.strip().lower() in taken else c for c in df.columns]
    return df.toDF(*names)


def clean_names(names: Sequence[str | None]) -> list[str]:
    """Blank names become 'Colonna N', repeated ones 'name (k)', without regard to case."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names, 1):
        base = (n or "").strip() or f"Colonna {i}"
        k = seen[base.lower()] = seen.get(base.lower(), 0) + 1
        out.append(base if k == 1 else f"{base} ({k})")
    return out


def merge_same_columns(df: DataFrame) -> DataFrame:
    """Columns equal but for case and blanks become one, the first value that is not null wins.

    Works on positions, so names that Spark can't tell apart are no trouble.
    """
    plain = df.toDF(*[f"__{i}" for i in range(len(df.columns))])
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        groups.setdefault(" ".join(c.split()).lower(), []).append(i)
    return plain.select(*(F.coalesce(*(F.col(f"__{i}") for i in ids)).alias(df.columns[ids[0]].strip()) for ids in groups.values()))


def column_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(colonna, pieni, numerici, interi, distinti, tipo) of text columns, in one pass: numeric if all filled cells are."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("colonna"), blank_to_null(F.col(c).cast("string")).alias("v")) for c in columns))).alias("x")).select("x.*")
    num = F.col("v").try_cast("double")
    return (
        cells.groupBy("colonna")
        .agg(F.count("v").alias("pieni"), F.count(num).alias("numerici"), F.count(F.when(num == F.floor(num), 1)).alias("interi"), F.countDistinct("v").alias("distinti"))
        .withColumn("tipo", F.when(F.col("pieni") == 0, "vuota").when(F.col("interi") == F.col("pieni"), "intero").when(F.col("numerici") == F.col("pieni"), "numero").otherwise("testo"))
    )


def measures_to_metres(df: DataFrame, column: str, header: str = "", by: Sequence[str] = ()) -> DataFrame:
    """A measure column in metres: by the unit in its header, else divided by 100 if most values exceed 5."""
    v = without_sentinels(F.col(column).cast("double"))
    head = header.lower()
    if "mm" in head:
        return df.withColumn(column, v / 1000)
    if "cm" in head:
        return df.withColumn(column, v / 100)
    if head:
        return df.withColumn(column, v)
    share = df.select(*by, v.alias("v")).groupBy(*by).agg((F.avg(F.when(F.col("v").isNotNull(), (F.col("v") > 5).cast("int"))) > 0.5).alias("__cm"))
    joined = df.join(F.broadcast(share), list(by), "left") if by else df.crossJoin(F.broadcast(share))
    return joined.withColumn(column, F.when(F.col("__cm"), v / 100).otherwise(v)).drop("__cm")


def local_frame(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Origin of the local coordinates of each group: whole metres below the least x, y and z - 0.5."""
    return points.groupBy(*by).agg(F.floor(F.min(x)).alias("x0"), F.floor(F.min(y)).alias("y0"), F.floor(F.min(F.col(z) - 0.5)).alias("z0"))


def json_rows(df: DataFrame, digits: int = 3) -> DataFrame:
    """One JSON text a row: dates as dd/mm/yyyy, numbers rounded, nulls left out."""
    cols = []
    for n, t in df.dtypes:
        c = F.col(n)
        cols.append((F.date_format(c, "dd/MM/yyyy") if t in ("date", "timestamp") else F.round(c, digits) if t in ("double", "float") else c).alias(n))
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def vertices(df: DataFrame, key: str, rings: str) -> DataFrame:
    """(key, anello, vertice, x, y) of all polygons, numbered from 1."""
    return df.select(F.col(key), F.posexplode(rings).alias("anello", "r")).select(key, (F.col("anello") + 1).alias("anello"), F.posexplode("r").alias("vertice", "p")).select(
        key, F.col("anello").cast("bigint").alias("anello"), (F.col("vertice") + 1).cast("bigint").alias("vertice"), "p.x", "p.y"
    )


def level_kinds(levels: DataFrame, units: DataFrame) -> DataFrame:
    """Kinds of levels by kind of unit: cuts have rim and cut, masonry crest and foundation.

    ``levels``: (unita, tipo, ...); ``units``: (unita, classe) with 'negativa' or 'muraria'.
    """
    k = units.select(F.col("unita").alias("__u"), "classe")
    fixed = (
        F.when((F.col("classe") == "negativa") & (F.col("tipo") == "vertice"), "orlo")
        .when((F.col("classe") == "negativa") & F.col("tipo").isin("sup", "inf"), "taglio")
        .when((F.col("classe") == "muraria") & (F.col("tipo") == "sup"), "rasatura")
        .when((F.col("classe") == "muraria") & (F.col("tipo") == "inf"), "fondazione")
        .otherwise(F.col("tipo"))
    )
    return levels.join(k, levels.unita == k["__u"], "left").withColumn("tipo", fixed).drop("__u", "classe")


def class_ranges(df: DataFrame, cls: str, num: str) -> DataFrame:
    """Disjoint ranges of ids: adds ``base`` (by rank of class) and ``codice`` = base + number.

    The step is 10 to the power of the digits of the greatest number, at least 1000.
    """
    classes = df.where(F.col(cls).isNotNull()).select(cls).distinct().withColumn("__r", F.dense_rank().over(Window.orderBy(cls)))
    digits = df.agg(F.greatest(F.lit(3), F.length(F.max(num).cast("string"))).alias("__d"))
    table = classes.crossJoin(digits).select(F.col(cls).alias("__c"), (F.col("__r") * F.pow(F.lit(10), F.col("__d"))).cast("bigint").alias("base"))
    return df.join(F.broadcast(table), F.col(cls) == F.col("__c")).drop("__c").withColumn("codice", F.col("base") + F.col(num))


# Filters


def keep_values(df: DataFrame, column: str, values: Sequence[str], exclude: bool = False) -> DataFrame:
    """IN or NOT IN as text: 3.0 is compared as '3', the column is found without regard to case; nulls never match."""
    name = next((c for c in df.columns if c.lower() == column.lower()), None)
    if name is None:
        return df
    text = F.trim(F.regexp_replace(F.col(name).cast("string"), r"^(-?[0-9]+)\.0+$", "$1"))
    hit = F.coalesce(text.isin([str(v) for v in values]), F.lit(False))
    return df.where(~hit if exclude else hit)


def clean_relations(rel: DataFrame, units: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Without relations of a unit to itself or to a unit outside the set."""
    u = units.select(F.col("unita")).distinct()
    return rel.where(F.col(a) != F.col(b)).join(u.withColumnRenamed("unita", a), a, "left_semi").join(u.withColumnRenamed("unita", b), b, "left_semi").select(*rel.columns)


def crop(points: DataFrame, plans: DataFrame, by: Sequence[str], buffer: float = 20.0) -> DataFrame:
    """Points within ``buffer`` of the extent (x0, y0, x1, y1) of their group; groups without extent are kept."""
    ext = plans.groupBy(*by).agg(F.min("x0").alias("__a"), F.min("y0").alias("__b"), F.max("x1").alias("__c"), F.max("y1").alias("__d"))
    inside = F.col("x").between(F.col("__a") - buffer, F.col("__c") + buffer) & F.col("y").between(F.col("__b") - buffer, F.col("__d") + buffer)
    return points.join(ext, list(by), "left").where(F.col("__a").isNull() | inside).drop("__a", "__b", "__c", "__d")


# Joins


def first_rows(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """One row a key: the first by ``order``. An aggregate with partial combine, not a window."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__s")).select(*keys, *(F.col("__s").getField(c).alias(c) for c in rest)).select(*df.columns)


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__s")).select(key, *(F.col("__s").getField(c).alias(c) for c in rest)).select(*df.columns)


def lookup_chain(df: DataFrame, links: Sequence[tuple[DataFrame, str, str, Mapping[str, str], str]]) -> DataFrame:
    """Chained lookups: each (table, its key, our key, {their column: our new column}, order).

    A later link may use columns that an earlier one brought. Keys compare as text with 3.0 as '3'; of
    repeated keys the first row by ``order`` counts; unmatched rows get nulls.
    """
    for right, theirs, ours, columns, order in links:
        text = lambda c: F.regexp_replace(F.trim(c.cast("string")), r"^(-?[0-9]+)\.0+$", "$1")
        dim = right.where(F.col(theirs).isNotNull()).groupBy(text(F.col(theirs)).alias("__k")).agg(F.min_by(F.struct(*columns), F.col(order)).alias("__s"))
        dim = dim.select("__k", *(F.col("__s").getField(k).alias(v) for k, v in columns.items()))
        df = df.join(dim, text(F.col(ours)) == F.col("__k"), "left").drop("__k")
    return df


def enrich(df: DataFrame, layer: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Blank values filled from the first value that a layer has for the unit."""
    pick = [F.min_by(blank_to_null(F.col(c).cast("string")), F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns]
    side = layer.groupBy(F.col(key).alias("__k")).agg(*pick)
    out = df.join(side, F.col(key) == F.col("__k"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(blank_to_null(F.col(c).cast("string")), F.col(f"__{c}")))
    return out.drop("__k", *(f"__{c}" for c in columns))


def complete(records: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """Units with a record, a plan or both: (key, scheda, pianta); rows without key are none."""
    records, plans = records.where(F.col(key).isNotNull()), plans.where(F.col(key).isNotNull())
    r = records.select(key).distinct().withColumn("scheda", F.lit(True))
    p = plans.select(key).distinct().withColumn("pianta", F.lit(True))
    return r.join(p, key, "full_outer").select(key, F.coalesce("scheda", F.lit(False)).alias("scheda"), F.coalesce("pianta", F.lit(False)).alias("pianta"))


def inherited_plans(relations: DataFrame, planned: DataFrame) -> DataFrame:
    """(unita, da): a fill without plan takes that of the first planned unit it fills.

    ``relations``: (riga, a, rel, b), already canonical; ``planned``: (unita).
    """
    p = planned.select("unita").distinct()
    fills = relations.where("rel = 'riempie'")
    return (
        fills.join(p, fills.a == p.unita, "left_anti").join(p, F.col("b") == p.unita).groupBy(F.col("a").alias("unita")).agg(F.min_by("b", "riga").alias("da"))
    )


def changed(before: DataFrame, after: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, stato) of units whose fingerprints differ: 'nuova', 'tolta' or 'cambiata'."""
    b, a = before.select(F.col(key).alias("__b"), F.col(mark).alias("__m")), after.select(key, mark)
    j = a.join(b, F.col(key) == F.col("__b"), "full_outer").where(~F.col(mark).eqNullSafe(F.col("__m")))
    return j.select(F.coalesce(key, "__b").alias(key), F.when(F.col("__b").isNull(), "nuova").when(F.col(key).isNull(), "tolta").otherwise("cambiata").alias("stato"))


def by_priority(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]], left_id: str, right_cols: Sequence[str], order: str) -> DataFrame:
    """Tiered equi-join: the first tier that matches wins; within it the first row by ``order``.

    One hash join a tier over all rows, then one aggregate; no or-condition, so no nested loop.
    """
    tiers = [left.join(right, lk == rk).select(left_id, F.lit(i).alias("tier"), order, *right_cols) for i, (lk, rk) in enumerate(keys)]
    best = reduce(DataFrame.unionByName, tiers).groupBy(left_id).agg(F.min_by(F.struct("tier", *right_cols), F.struct("tier", order)).alias("s"))
    return best.select(left_id, "s.*")


def glob_regex(pattern: str) -> str:
    """A file pattern with * and ? as a regular expression of the common subset."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".^$+{}[]()|\/" else c for c in pattern) + "$"


# Aggregates


def phase_rollup(df: DataFrame, phase: str, area: str, volume: str | None = None) -> DataFrame:
    out = df.groupBy(phase).agg(F.count(F.lit(1)).alias("unita"), F.round(F.sum(area), 2).alias("area"), *([F.round(F.sum(volume), 3).alias("volume")] if volume else []))
    return out


def level_extrema(levels: DataFrame) -> DataFrame:
    """Per unit: highest and lowest level, mean crest; ``levels``: (unita, tipo, z) without sentinels."""
    return levels.groupBy("unita").agg(
        F.max("z").alias("z_max"), F.min("z").alias("z_min"), F.avg(F.when(F.col("tipo") == "rasatura", F.col("z"))).alias("cresta"), F.count(F.lit(1)).alias("quote")
    )


def typical_medians(df: DataFrame, group: Column, value: str, least: int = 3) -> DataFrame:
    """Median of a value by definition, for groups of at least ``least`` values."""
    g = df.where(F.col(value).isNotNull() & group.isNotNull()).groupBy(group.alias("gruppo")).agg(F.median(value).alias("mediana"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least)


def top_values(df: DataFrame, column: str, k: int = 60) -> DataFrame:
    """The k most frequent values with counts, and the number of different ones; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("valore")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("distinti"))
    return counts.orderBy(F.desc("n"), "valore").limit(k).crossJoin(F.broadcast(total))


def pivot_fields(df: DataFrame, key: str, field: str, value: str, order: str, names: Sequence[str]) -> DataFrame:
    """Field/value rows to one row a unit; the first value by ``order`` wins."""
    firsts = df.where(F.col(field).isin(list(names))).groupBy(key, field).agg(F.min_by(value, order).alias("v"))
    return firsts.groupBy(key).agg(*(F.max(F.when(F.col(field) == n, F.col("v"))).alias(n) for n in names))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str, value: str) -> DataFrame:
    """Wide to long without null and zero values."""
    return df.unpivot(list(ids), list(columns), variable, value).where(F.col(value).isNotNull() & (F.col(value) != 0))


def fingerprints(df: DataFrame, key: str, parts: Sequence[Column]) -> DataFrame:
    """SHA-256 of the texts of a unit's rows: the order of rows does not matter.

    Lines are gathered in 4,096 parts of a unit by the first digits of their MD5, each part sorted and hashed, then
    the hashes of the parts: no row holds a whole hot unit.
    """
    line = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    rows = df.select(F.col(key).alias("__key"), line.alias("__line")).withColumn("__part", F.substring(F.md5("__line"), 1, 3))
    part = rows.groupBy("__key", "__part").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("__line"))), 256).alias("__h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__part", "__h"))), lambda x: x["__h"])
    return part.groupBy(F.col("__key").alias(key)).agg(F.sha2(F.concat_ws("\n", whole), 256).alias("impronta"))


def with_total(df: DataFrame, key: str, sums: Sequence[str], label: str = "TOTALE") -> DataFrame:
    """A grouped table with a total row on top of its groups (one rollup)."""
    g = df.withColumn("__k", F.col(key).cast("string"))
    return g.rollup("__k").agg(*(F.sum(s).alias(s) for s in sums), F.grouping("__k").alias("__g")).select(F.when(F.col("__g") == 1, label).otherwise(F.col("__k")).alias(key), *sums)


def mixed_fields(df: DataFrame, field: str, value: str) -> DataFrame:
    """Fields whose values are neither mostly numbers nor mostly text: share of numbers between 0.2 and 0.8."""
    num = F.col(value).try_cast("double").isNotNull()
    return df.where(F.col(value).isNotNull()).groupBy(field).agg(F.round(F.avg(num.cast("int")), 4).alias("quota")).where("quota > 0.2 and quota < 0.8")


# Ordered steps


def number_phases(df: DataFrame, period: str, phase: str, start: str, end: str) -> DataFrame:
    """(period, phase) keys numbered 1..n: those with a year first, by first year else last, then by key."""
    keys = df.groupBy(period, phase).agg(F.min(start).alias("da"), F.max(end).alias("a"))
    year = F.coalesce("da", "a")
    return keys.withColumn("fase_n", F.row_number().over(Window.orderBy(year.isNull(), year, F.col(period), F.col(phase))).cast("bigint"))


def tops_in_cut(fills: DataFrame, rim: Column, depth: Column) -> DataFrame:
    """Top of each fill: rim less what lies above it, at most the depth less 3 cm. ``fills``: (taglio, ordine, unita, spessore)."""
    above = F.coalesce(F.sum("spessore").over(Window.partitionBy("taglio").orderBy("ordine", "unita").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return fills.withColumn("tetto", rim - F.least(above, F.greatest(depth - 0.03, F.lit(0.0))))


def shared_thickness(fills: DataFrame, depth: Column) -> DataFrame:
    """Missing thicknesses share what is left of the depth (at least 5 cm each); too great a sum is scaled down."""
    w = Window.partitionBy("taglio")
    known = F.sum("spessore").over(w)
    missing = F.sum(F.col("spessore").isNull().cast("int")).over(w)
    filled = fills.withColumn("__d", depth).withColumn("__t", F.coalesce("spessore", F.greatest((F.col("__d") - F.coalesce(known, F.lit(0.0))) / missing, F.lit(0.05))))
    total = F.sum("__t").over(w)
    return filled.withColumn("spessore_stimato", F.when(total > F.col("__d") * 1.05, F.col("__t") * F.col("__d") / total).otherwise(F.col("__t"))).drop("__d", "__t")


def survey_days(df: DataFrame, unit: str, ts: str) -> DataFrame:
    """First and last day a unit was surveyed, as days and as 0-based places among all survey days."""
    days = df.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("giorno")).distinct()
    index = days.withColumn("k", F.dense_rank().over(Window.orderBy("giorno")).cast("bigint") - 1)
    per = df.where(F.col(unit).isNotNull() & F.col(ts).isNotNull()).groupBy(unit).agg(F.min(F.to_date(ts)).alias("primo"), F.max(F.to_date(ts)).alias("ultimo"))
    a, b = index.toDF("primo", "k_primo"), index.toDF("ultimo", "k_ultimo")
    return per.join(a, "primo").join(b, "ultimo").select(unit, F.col("primo").cast("string").alias("primo"), F.col("ultimo").cast("string").alias("ultimo"), "k_primo", "k_ultimo")


def unique_labels(df: DataFrame, name: str, order: str, blank: str) -> DataFrame:
    """Blank names become '<blank> i', repeated ones 'name (k)', k by ``order``; blanks are numbered without one window over all."""
    own = blank_to_null(F.col(name))
    named = df.where(own.isNotNull()).withColumn("__b", own)
    blanks = row_numbers(df.where(own.isNull()), "__blank", F.col(order)).withColumn("__b", F.concat(F.lit(blank + " "), F.col("__blank").cast("string"))).drop("__blank")
    k = F.row_number().over(Window.partitionBy("__b").orderBy(order))
    both = named.unionByName(blanks)
    return both.withColumn("etichetta", F.when(k == 1, F.col("__b")).otherwise(F.concat("__b", F.lit(" ("), k.cast("string"), F.lit(")")))).drop("__b")


def arc_length(df: DataFrame, key: Sequence[str], pos: str, x: str, y: str) -> DataFrame:
    """Distance along a line up to each of its points."""
    w = Window.partitionBy(*key).orderBy(pos)
    step = F.coalesce(F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)), F.lit(0.0))
    return df.withColumn("__s", step).withColumn("arco", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def imputed_year(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The year most dates of a unit have; ties go to the earlier one."""
    c = df.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.year(ts).alias("anno")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.max_by("anno", F.struct(F.col("n"), -F.col("anno"))).alias("anno"))
