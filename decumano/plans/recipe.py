"""Recipes: which sheet and column of an archive is what, proposed from statistics, kept as JSON, applied as one plan."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph
from ..operators import relational as R
from ..operators.vocabulary import Vocabulary

#: Least share of values that parse as unit numbers, and least score of a column, to be taken as unit ids.
ID_SHARE, ID_SCORE, COLUMN_SCORE = 0.60, 0.45, 0.75


@dataclass
class Recipe:
    """Everything needed to turn an archive into the canonical tables."""

    records: str | None = None
    unit: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    relations: dict = field(default_factory=dict)
    linked: dict[str, str] = field(default_factory=dict)
    layers: dict[str, str] = field(default_factory=dict)
    filters: list[dict] = field(default_factory=list)
    values: dict[str, dict[str, str]] = field(default_factory=dict)
    nulls: list[float] = field(default_factory=lambda: list(S.SENTINELS))
    reasons: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        known = set(cls.__dataclass_fields__)
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})


def statistics(sheets: Mapping[str, DataFrame]) -> dict[str, dict[str, dict]]:
    """Per sheet and column: filled, numeric, whole, distinct and parsing as unit, one aggregate a sheet."""
    out: dict[str, dict[str, dict]] = {}
    for name, df in sheets.items():
        aggs = []
        for i, c in enumerate(df.columns):
            v = S.blank_to_null(F.col(f"`{c}`").cast("string"))
            num = v.try_cast("double")
            aggs += [F.count(v).alias(f"{i}_pieni"), F.count(num).alias(f"{i}_numerici"), F.count(F.when(num == F.floor(num), 1)).alias(f"{i}_interi"), F.countDistinct(v).alias(f"{i}_distinti"), F.count(F.when(v.rlike(r"^(?i:usm?|su|ctx|context)?[ ._-]*[0-9]{1,18}(\.0)?[a-z]?$"), 1)).alias(f"{i}_unita")]
        row = df.agg(F.count(F.lit(1)).alias("righe"), *aggs).first().asDict()
        out[name] = {c: {"righe": row["righe"], **{k: row[f"{i}_{k}"] for k in ("pieni", "numerici", "interi", "distinti", "unita")}} for i, c in enumerate(df.columns)}
    return out


def id_score(s: dict) -> float:
    """How likely a column holds the unit of each record: it parses, is filled and repeats little."""
    if not s["pieni"] or s["unita"] / s["pieni"] < ID_SHARE:
        return 0.0
    return 0.5 * s["unita"] / s["pieni"] + 0.3 * s["pieni"] / max(1, s["righe"]) + 0.2 * s["distinti"] / s["pieni"]


def propose(sheets: Mapping[str, DataFrame], vocabulary: Vocabulary | None = None) -> Recipe:
    """The likeliest recipe for a set of sheets: record sheet, its columns, the relations and linked sheets, with reasons."""
    v, stats, r = vocabulary or Vocabulary(), statistics(sheets), Recipe()
    concept = {s: {c: next(iter(v.recognise(c)), (None, 0.0)) for c in cols} for s, cols in stats.items()}
    best = (0.0, None, None)
    for s, cols in stats.items():
        for c, st in cols.items():
            k, sure = concept[s][c]
            own = sum(1 for x, _ in concept[s].values() if x in ("definizione", "tipo", "descrizione", "fase", "periodo", "riempie"))
            sc = id_score(st) + (0.4 * sure if k == "unita" else 0.0) + 0.05 * own + (0.3 if st["distinti"] >= 0.9 * max(1, st["pieni"]) else 0.0)
            if id_score(st) >= ID_SCORE and sc > best[0]:
                best = (sc, s, c)
    _, r.records, r.unit = best
    if r.records is None:
        r.reasons.append("no sheet holds a column of unit numbers")
        return r
    r.reasons.append(f"{r.records}: its column {r.unit} holds the unit numbers")
    for c, (k, sure) in sorted(concept[r.records].items(), key=lambda x: -x[1][1]):
        if c != r.unit and k and sure >= COLUMN_SCORE and k not in r.columns and k not in ("unita", "rapporto", "correlata"):
            r.columns[k] = c
    for s, cols in concept.items():
        kinds = {k: c for c, (k, sure) in cols.items() if sure >= COLUMN_SCORE}
        if {"rapporto", "correlata"} <= set(kinds) and "unita" in kinds:
            r.relations = {"sheet": s, "a": kinds["unita"], "rel": kinds["rapporto"], "b": kinds["correlata"]}
        elif s != r.records and "unita" in kinds and "materiale" in kinds:
            r.linked[s] = kinds["unita"]
    if not r.relations and "riempie" in r.columns:
        r.relations = {"columns": {"riempie": r.columns["riempie"]}}
    r.reasons.append(f"relations: {r.relations or 'none'}")
    return r


def adapt(recipe: Recipe, sheets: Mapping[str, Sequence[str]]) -> Recipe:
    """A saved recipe for this archive: sheets by pattern, columns only if they are there."""
    find = lambda p: next((s for s in sheets if fnmatch.fnmatch(s.lower(), p.lower())), None) if p else None
    rec = find(recipe.records)
    cols = {c.lower() for c in sheets.get(rec, ())} if rec else set()
    linked = {find(s): c for s, c in recipe.linked.items() if find(s)}
    rel = dict(recipe.relations)
    if "sheet" in rel:
        rel["sheet"] = find(rel["sheet"])
        rel = rel if rel["sheet"] else {}
    return Recipe(**{**asdict(recipe), "records": rec, "columns": {k: c for k, c in recipe.columns.items() if c.lower() in cols}, "linked": linked, "relations": rel})


def override(recipe: Recipe, **changes) -> Recipe:
    """A recipe with choices made by hand; dictionaries are merged, null takes an entry out."""
    base = asdict(recipe)
    for k, v in changes.items():
        base[k] = {x: y for x, y in {**base[k], **v}.items() if y is not None} if isinstance(v, dict) else v
    return Recipe(**base)


def apply(recipe: Recipe, sheets: Mapping[str, DataFrame], wordings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The canonical tables of an archive: 'us' (unita, ...), 'relazioni' (a, rel, b) and the linked sheets.

    Relations come in any of four encodings, and several together: a sheet of rows (sheet, a, rel, b), list
    columns of the record sheet named by relation (columns), columns of free text or lists of lists (text), and
    columns that name a parent unit (parents, by relation). ``wordings``: (termine, canonico), further wordings
    of the relations in the sheet, misspelt ones included (``phrases.meanings``).

    Filters, renames, casts and relations are one lazy plan: sheets are read once, unused columns not at all.
    """
    df = sheets[recipe.records]
    for f in recipe.filters:
        df = R.keep_values(df, f["column"], f["values"], f.get("exclude", False))
    q = lambda c: F.col(f"`{c}`")
    cols = [S.unit_number(q(recipe.unit)).alias("unita")]
    for k, c in recipe.columns.items():
        text = S.blank_to_null(q(c).cast("string"))
        if k in recipe.values:
            m = F.create_map([F.lit(x) for kv in recipe.values[k].items() for x in kv])
            text = F.coalesce(F.try_element_at(m, F.lower(text)), text)
        cols.append((S.without_sentinels(S.number(q(c).cast("string")), recipe.nulls) if k in ("profondita", "quota", "peso", "numero") else S.unit_number(q(c)) if k in ("riempie", "copre", "coperto") else text).alias(k))
    us = df.select(*cols).where("unita is not null")
    out = {"us": us}
    pairs = _relations(recipe, df, sheets, wordings)
    if pairs:
        out["relazioni"] = R.clean_relations(reduce(DataFrame.unionByName, pairs).distinct(), us)
    for s, c in recipe.linked.items():
        t = sheets[s].withColumn("unita", S.unit_number(q(c)))
        out[s] = t.join(us.select("unita").distinct(), "unita", "left_semi")
    return out


def _relations(recipe: Recipe, df: DataFrame, sheets: Mapping[str, DataFrame], wordings: DataFrame | None) -> list[DataFrame]:
    """(a, rel, b) of each encoding that the recipe names; inverse forms swapped."""
    rel, parts = recipe.relations, []
    q = lambda c: F.col(f"`{c}`")
    unit = S.unit_number(q(recipe.unit)) if recipe.unit else None

    def swapped(a, r, b):
        return F.when(r["inversa"], b).otherwise(a).alias("a"), r["rel"].alias("rel"), F.when(r["inversa"], a).otherwise(b).alias("b")

    if "sheet" in rel:
        t = sheets[rel["sheet"]].select(S.unit_number(q(rel["a"])).alias("a"), q(rel["rel"]).cast("string").alias("phrase"), S.unit_number(q(rel["b"])).alias("b"))
        parts.append(graph.resolve(t, wordings).where("r.rel is not null").select(*swapped(F.col("a"), F.col("r"), F.col("b"))))
    for k, c in rel.get("columns", {}).items():
        numbers = F.transform(F.regexp_extract_all(q(c).cast("string"), F.lit("([0-9]{1,18})"), 1), lambda n: n.try_cast("bigint"))
        e = df.select(unit.alias("x"), S.relation_of(F.lit(k)).alias("r"), F.explode(numbers).alias("y"))
        parts.append(e.select(*swapped(F.col("x"), F.col("r"), F.col("y"))))
    for c in rel.get("text", ()):
        e = df.select(unit.alias("x"), F.explode(S.relations_in_text(q(c).cast("string"))).alias("r"))
        parts.append(e.select(*swapped(F.col("x"), F.col("r"), F.col("r.unita"))))
    for k, c in rel.get("parents", {}).items():
        e = df.select(unit.alias("x"), S.relation_of(F.lit(k)).alias("r"), S.unit_number(q(c)).alias("y"))
        parts.append(e.select(*swapped(F.col("x"), F.col("r"), F.col("y"))))
    return parts
