"""Column functions: numbers, measures, identifiers, dates and phrases as people type them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that stand for "unknown" (fixed values).
SENTINELS = (-9999.0, -999.0, -99.99, 999999.0)
#: Letters with diacritics and what remains of them.
_MARKED = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def plain(c: Column) -> Column:
    """Lower case without common diacritics, single spaces; stays in generated code."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), r"\s+", " "))


def is_sentinel(c: Column, sentinels: Sequence[float] = SENTINELS, tolerance: float = 1e-6) -> Column:
    out = F.lit(False)
    for s in sentinels:
        out = out | (F.abs(c - F.lit(s)) < tolerance)
    return out


def without_sentinels(c: Column, sentinels: Sequence[float] = SENTINELS) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & ~is_sentinel(c, sentinels), c)


def unit_number(c: Column) -> Column:
    """The number of a unit: whole numbers as they are, of a text the first run of one to eighteen digits.

    1005, 'US 1005' and '1005.0' are 1005. Text is cut at eighteen digits only, which a BIGINT holds.
    """
    return F.coalesce(c.cast("string").try_cast("bigint"), F.regexp_extract(c.cast("string"), r"([0-9]{1,18})", 1).try_cast("bigint"))


def number(c: Column) -> Column:
    """A number with a decimal point or comma; NaN and anything else is null."""
    v = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(v), v)


def measure(c: Column, default: float = 1.0) -> Column:
    """Metres from '0,45 m', '45cm', '1.234,5' or '1 234,5 mm'; a number alone is multiplied by ``default``."""
    t = F.lower(F.trim(c))
    unit = F.regexp_extract(t, r"(mm|cm|m)\.?$", 1)
    digits = F.regexp_replace(F.regexp_replace(t, r"\s*(mm|cm|m)\.?$", ""), r"\s", "")
    both = digits.contains(".") & digits.contains(",")
    it = both & (F.locate(",", digits) > F.locate(".", digits))
    text = F.when(it, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    v = F.when(text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), text.cast("double"))
    return v * F.when(unit == "mm", 0.001).when(unit == "cm", 0.01).when(unit == "m", 1.0).otherwise(default)


def identifier_parts(c: Column) -> Column:
    """Prefix, number, suffix and whether it holds several numbers."""
    t = F.trim(c)
    return F.struct(
        F.trim(F.regexp_extract(t, r"^([^0-9]*)[0-9]", 1)).alias("prefisso"),
        F.regexp_extract(t, r"([0-9]+)[^0-9]*$", 1).try_cast("bigint").alias("numero"),
        F.trim(F.regexp_extract(t, r"[0-9]([^0-9]*)$", 1)).alias("suffisso"),
        (F.size(F.regexp_extract_all(t, F.lit(r"([0-9]+)"), 1)) != 1).alias("ambiguo"),
    )


def class_code(c: Column) -> Column:
    """Class and number of a code such as A1, US.B12 or GR2; nulls if it is none."""
    t = F.upper(F.regexp_replace(F.trim(c), r"^(?i:usm?|su|ctx)[ .\-]*", ""))
    ok = t.rlike(r"^[A-Z]{1,4}[ .\-]?[0-9]{1,6}$")
    return F.struct(F.when(ok, F.regexp_extract(t, r"^([A-Z]{1,4})", 1)).alias("classe"), F.when(ok, F.regexp_extract(t, r"([0-9]{1,6})$", 1).cast("bigint")).alias("numero"))


def dates_in(c: Column) -> Column:
    """All dates Y-M-D in a cell, sorted and distinct, checked by range only (month 1-12, day 1-31)."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})"), 1)
    iso = F.transform(parts, lambda p: F.concat_ws("-", F.split(p, "-")[0], F.lpad(F.split(p, "-")[1], 2, "0"), F.lpad(F.split(p, "-")[2], 2, "0")))
    return F.array_sort(F.array_distinct(F.filter(iso, lambda d: F.substring(d, 6, 2).between("01", "12") & F.substring(d, 9, 2).between("01", "31"))))


def ddmm_date(name: Column, year: Column) -> Column:
    """The last four-digit token of a file name that is a day and month, with the year of its folder."""
    tokens = F.regexp_extract_all(name, F.lit(r"([0-9]+)"), 1)
    ok = F.filter(tokens, lambda t: (F.length(t) == 4) & F.substring(t, 1, 2).between("01", "31") & F.substring(t, 3, 2).between("01", "12"))
    last = F.try_element_at(ok, F.lit(-1))
    return F.when(last.isNotNull(), F.concat_ws("-", year.cast("string"), F.substring(last, 3, 2), F.substring(last, 1, 2)))


def mask_noise(c: Column) -> Column:
    """Digits of dates, scales, resolutions and camera counters replaced by '#', so that bare numbers remain."""
    t = c
    for rx in (r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", r"1:[0-9]+", r"[0-9]+\s*(?i:dpi|px|ppi)", r"(?i:img|dsc|dscn|foto|photo)[_ -]*[0-9]+", r"(?i:tav|tavola|sheet|fig)[._ -]*[0-9]+"):
        t = F.regexp_replace(t, rx, "#")
    return t


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (F.lit(3.0) - u * 2)


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of box ``b`` (x0, y0, x1, y1) that box ``a`` covers."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h / ((b[2] - b[0]) * (b[3] - b[1]))


#: The ten relations, as (relation, ends swapped), and the ways to write them in Italian, English,
#: French, German and Spanish, without diacritics.
RELATIONS: dict[str, tuple[str, bool]] = {
    "copre": ("copre", False),
    "coperto da": ("copre", True),
    "taglia": ("taglia", False),
    "tagliato da": ("taglia", True),
    "riempie": ("riempie", False),
    "riempito da": ("riempie", True),
    "si appoggia a": ("si appoggia a", False),
    "gli si appoggia": ("si appoggia a", True),
    "si lega a": ("si lega a", False),
    "uguale a": ("uguale a", False),
}
WORDINGS: dict[str, tuple[str, ...]] = {
    "copre": ("copre", "sopra", "sopra a", "covers", "overlies", "above", "over", "seals", "couvre", "recouvre", "scelle", "sur", "uberdeckt", "uberlagert", "liegt uber", "cubre", "cubre a", "sella", "sobre", ">"),
    "coperto da": ("coperto da", "coperta da", "sotto", "sotto a", "covered by", "is covered by", "overlain by", "underlies", "below", "under", "sealed by", "couvert par", "recouvert par", "sous", "uberdeckt von", "uberlagert von", "liegt unter", "unter", "cubierto por", "cubierta por", "bajo", "debajo de", "<"),
    "taglia": ("taglia", "cuts", "coupe", "recoupe", "entaille", "schneidet", "corta", "corta a"),
    "tagliato da": ("tagliato da", "tagliata da", "cut by", "is cut by", "coupe par", "recoupe par", "entaille par", "geschnitten von", "cortado por", "cortada por"),
    "riempie": ("riempie", "riempimento di", "fills", "fill of", "remplit", "comble", "verfullt", "verfullung von", "rellena", "rellena a", "relleno de"),
    "riempito da": ("riempito da", "riempita da", "filled by", "is filled by", "rempli par", "comble par", "verfullt von", "verfullt durch", "rellenado por", "rellenada por"),
    "si appoggia a": ("si appoggia a", "abuts", "abuts against", "butts", "s'appuie contre", "s'appuie sur", "s'appuie a", "stoßt an", "stosst an", "se apoya en", "se apoya a", "se adosa a"),
    "gli si appoggia": ("gli si appoggia", "le si appoggia", "abutted by", "is abutted by", "butted by", "sert d'appui a", "angestoßen von", "se le apoya"),
    "si lega a": ("si lega a", "legato con", "bonded with", "bonded to", "bonds with", "tied to", "lie a", "liee a", "im verband mit", "verzahnt mit", "trabado con", "enlaza con"),
    "uguale a": ("uguale a", "corrisponde a", "same as", "equal to", "equals", "egal a", "identique a", "identisch mit", "entspricht", "igual a", "igual que", "=", "==", "≡"),
}
RELATION_PHRASES: dict[str, tuple[str, bool]] = {w: RELATIONS[r] for r, ways in WORDINGS.items() for w in ways}
DIRECT = ("copre", "taglia", "riempie", "si appoggia a")
CONTEMPORARY = ("si lega a", "uguale a")


def _phrase(c: Column) -> Column:
    return F.regexp_replace(plain(c), "’", "'")


def relation_of(c: Column) -> Column:
    """(canonical relation, ends swapped) of a phrase; nulls if it is none."""
    key = _phrase(c)
    name = F.create_map([F.lit(x) for k, (v, _) in RELATION_PHRASES.items() for x in (k, v)])
    swap = F.create_map([F.lit(x) for k, (_, v) in RELATION_PHRASES.items() for x in (k, v)])
    return F.struct(F.try_element_at(name, key).alias("rel"), F.try_element_at(swap, key).alias("inversa"))


def relations_in_text(c: Column, most: int | None = 200) -> Column:
    """Relations in free text, as an array of (rel, inversa, unita): all numbers from a phrase up to the next one.

    The longest phrase counts, at the borders of words. Ranges 1001-1004 and 1010-12 are extended if they hold
    at most ``most`` further numbers (None: however many); longer ones are taken as their two ends. A list of
    lists is read as ``relation_lists`` does.
    """
    words = sorted((p for p in RELATION_PHRASES if p[0].isalpha()), key=len, reverse=True)
    alt = r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])|==|=|≡|>|<"
    t = F.translate(_phrase(c), "_\x01", "  ")
    parts = F.split(F.regexp_replace(t, f"({alt})", "\x01$1"), "\x01")
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def numbers(block: Column) -> Column:
        found = F.regexp_extract_all(block, F.lit(r"([0-9]+(?:\s*[a-z](?![a-z]))?(?:\s*(?:-|–|—|\.\.|÷)\s*[0-9]+)?)"), 1)

        def span(x: Column) -> Column:
            a, b = F.regexp_extract(x, r"^([0-9]+)", 1), F.regexp_extract(x, r"[^0-9 ]\s*([0-9]+)$", 1)
            full = F.when(F.length(b) < F.length(a), F.concat(a.substr(F.lit(1), F.length(a) - F.length(b)), b)).otherwise(b)
            lo, hi = a.try_cast("bigint"), full.try_cast("bigint")
            fits = (hi > lo) if most is None else (hi > lo) & (hi <= lo + most)
            return F.when(b == "", F.array(lo)).when(fits, F.sequence(lo, hi)).otherwise(F.array(lo, F.when(hi > lo, hi).otherwise(b.try_cast("bigint"))))

        return F.flatten(F.transform(found, span))

    def one(block: Column) -> Column:
        rel = relation_of(F.regexp_extract(block, f"^({alt})", 1))
        return F.transform(numbers(block), lambda n: F.struct(rel["rel"].alias("rel"), rel["inversa"].alias("inversa"), n.alias("unita")))

    free = F.filter(F.flatten(F.transform(blocks, one)), lambda r: r["rel"].isNotNull() & r["unita"].isNotNull())
    return F.when(F.ltrim(c).startswith("[["), relation_lists(c)).otherwise(free)


def relation_lists(c: Column) -> Column:
    """Relations of a literal list of lists, [['Copre', '2', ...], ...], as an array of (rel, inversa, unita)."""
    arr = F.from_json(F.translate(c, "'", '"'), "array<array<string>>")
    return F.filter(
        F.transform(arr, lambda r: F.struct(relation_of(F.try_element_at(r, F.lit(1)))["rel"].alias("rel"), relation_of(F.try_element_at(r, F.lit(1)))["inversa"].alias("inversa"), unit_number(F.try_element_at(r, F.lit(2))).alias("unita"))),
        lambda r: r["rel"].isNotNull() & r["unita"].isNotNull(),
    )


def unit_colour(hex_: Column, masonry: Column, phase: Column, palette: Sequence[str], wall: str = "#8c8c8c") -> Column:
    """A valid hex colour, else one constant for masonry, else by phase from the palette, else a hue by golden angle."""
    pal = F.array(*(F.lit(p) for p in palette))
    by_phase = F.when(phase.between(1, len(palette)), F.try_element_at(pal, phase.cast("int")))
    hue = F.format_string("hsl(%d,45%%,55%%)", F.pmod(F.floor(phase * 137.508), F.lit(360)).cast("int"))
    return F.coalesce(F.when(hex_.rlike("^#[0-9A-Fa-f]{6}$"), F.lower(hex_)), F.when(masonry, F.lit(wall)), by_phase, F.when(phase.isNotNull(), hue), F.lit("#cccccc"))
