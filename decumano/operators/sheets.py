"""Raw sheets to tables: cells (foglio, riga, colonna, valore) in, tidy records out.

All steps are aggregates and windows within a sheet, so many sheets are tidied at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import plain, relation_of, unit_number

#: A header row: at least so many cells, this share of the width, this share of text, and no longer cell than this.
LEAST_CELLS, WIDTH_SHARE, TEXT_SHARE, LONGEST = 2, 0.5, 0.75, 80
FIRST_ROWS = 30
TOTAL_WORDS = ("totale", "totali", "total", "somma", "sum")


def grid(cells: DataFrame) -> DataFrame:
    """Cells as text, blanks left out; the word 'inf' stays text."""
    return cells.select("foglio", F.col("riga").cast("int"), F.col("colonna").cast("int"), F.trim(F.col("valore").cast("string")).alias("valore")).where("valore <> ''")


def is_number(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]+([.,][0-9]+)?$")


def row_profiles(cells: DataFrame) -> DataFrame:
    """(foglio, riga, n, testi, distinti, lunga, larghezza) of each row that holds a cell."""
    width = cells.groupBy("foglio").agg(F.max("colonna").alias("larghezza"))
    rows = cells.groupBy("foglio", "riga").agg(F.count(F.lit(1)).alias("n"), F.sum((~is_number(F.col("valore"))).cast("int")).alias("testi"), F.countDistinct(F.lower("valore")).alias("distinti"), F.max(F.length("valore")).alias("lunga"))
    return rows.join(width, "foglio")


def segments(cells: DataFrame) -> DataFrame:
    """Cells with ``tabella``: stacked tables, numbered from 1, are parted by blank rows (gaps and islands)."""
    rows = cells.select("foglio", "riga").distinct()
    w = Window.partitionBy("foglio").orderBy("riga")
    new = F.coalesce((F.col("riga") - F.lag("riga").over(w) > 1).cast("int"), F.lit(1))
    marks = rows.withColumn("__n", new).withColumn("tabella", F.sum("__n").over(w)).drop("__n")
    return cells.join(marks, ["foglio", "riga"])


def header_rows(cells: DataFrame) -> DataFrame:
    """(foglio, testata): the first row among the first FIRST_ROWS that looks like a header."""
    p = row_profiles(cells)
    ok = (F.col("n") >= LEAST_CELLS) & (F.col("n") >= F.col("larghezza") * WIDTH_SHARE) & (F.col("testi") >= F.col("n") * TEXT_SHARE) & (F.col("distinti") == F.col("n")) & (F.col("lunga") <= LONGEST)
    return p.where(ok & (F.col("riga") <= FIRST_ROWS)).groupBy("foglio").agg(F.min("riga").alias("testata"))


def column_names(cells: DataFrame, header: DataFrame, rows: int = 1) -> DataFrame:
    """(foglio, colonna, nome): header texts; of several header rows the upper ones are filled to the right and joined."""
    h = cells.join(header, "foglio").where((F.col("riga") > F.col("testata") - rows) & (F.col("riga") <= F.col("testata")))
    grid_ = cells.select("foglio", "colonna").distinct().join(header, "foglio").withColumn("riga", F.explode(F.sequence(F.col("testata") - (rows - 1), F.col("testata"))))
    full = grid_.join(h.select("foglio", "riga", "colonna", "valore"), ["foglio", "riga", "colonna"], "left")
    fill = F.last("valore", ignorenulls=True).over(Window.partitionBy("foglio", "riga").orderBy("colonna"))
    full = full.withColumn("v", F.when(F.col("riga") < F.col("testata"), fill).otherwise(F.col("valore")))
    g = full.groupBy("foglio", "colonna").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("riga", "v")))), lambda s: s["v"]), " ").alias("nome"))
    g = g.withColumn("nome", F.when(F.col("nome") == "", F.concat(F.lit("Colonna "), F.col("colonna").cast("string"))).otherwise(F.col("nome")))
    k = F.row_number().over(Window.partitionBy("foglio", F.lower("nome")).orderBy("colonna"))
    return g.withColumn("__k", k).select("foglio", "colonna", F.when(F.col("__k") == 1, F.col("nome")).otherwise(F.concat("nome", F.lit(" ("), F.col("__k").cast("string"), F.lit(")"))).alias("nome"))


def dropped_rows(cells: DataFrame, header: DataFrame) -> DataFrame:
    """(foglio, riga, motivo) of rows that are no records: 'titolo', 'testata', 'testata ripetuta', 'totale', 'nota'."""
    p = row_profiles(cells).join(header, "foglio")
    text = cells.groupBy("foglio", "riga").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("colonna", F.lower("valore").alias("v")))), lambda s: s["v"]), "|").alias("t"), F.min_by(plain(F.col("valore")), "colonna").alias("primo"))
    head = text.join(header, "foglio").where("riga = testata").select("foglio", F.col("t").alias("th"))
    last = row_profiles(cells).where("n > 1").groupBy("foglio").agg(F.max("riga").alias("ultima"))
    j = p.join(text, ["foglio", "riga"]).join(head, "foglio").join(last, "foglio", "left")
    why = (
        F.when(F.col("riga") < F.col("testata"), "titolo").when(F.col("riga") == F.col("testata"), "testata").when(F.col("t") == F.col("th"), "testata ripetuta")
        .when(F.split("primo", "[ :]")[0].isin(*TOTAL_WORDS), "totale").when((F.col("n") == 1) & ((F.col("lunga") > 40) | (F.col("riga") > F.col("ultima"))), "nota")
    )
    return j.select("foglio", "riga", why.alias("motivo")).where("motivo is not null")


def records(cells: DataFrame) -> DataFrame:
    """(foglio, riga, campo, valore): the cells of the record rows under the names of their columns."""
    c = grid(cells)
    head = header_rows(c)
    bad = dropped_rows(c, head).select("foglio", "riga")
    return c.join(head.select("foglio"), "foglio", "left_semi").join(bad, ["foglio", "riga"], "left_anti").join(column_names(c, head), ["foglio", "colonna"]).select("foglio", "riga", F.col("nome").alias("campo"), "valore")


def transposed(cells: DataFrame) -> DataFrame:
    """(foglio, record, campo, valore) of sheets with field names down the first column and a record in each other one."""
    c = grid(cells)
    names = c.where("colonna = 1").select("foglio", "riga", F.col("valore").alias("campo"))
    return c.where("colonna > 1").join(names, ["foglio", "riga"]).select("foglio", (F.col("colonna") - 1).alias("record"), "campo", "valore")


def label_blocks(cells: DataFrame, key: str) -> DataFrame:
    """(foglio, record, campo, valore) of forms: labels in odd columns, values beside them, a new record at the key label."""
    c = grid(cells)
    lab = c.where("colonna % 2 = 1").select("foglio", "riga", "colonna", F.regexp_replace("valore", r":\s*$", "").alias("campo"))
    val = c.where("colonna % 2 = 0").select("foglio", "riga", (F.col("colonna") - 1).alias("colonna"), "valore")
    pairs = lab.join(val, ["foglio", "riga", "colonna"], "left")
    w = Window.partitionBy("foglio").orderBy("riga", "colonna")
    return pairs.withColumn("record", F.sum((plain(F.col("campo")) == key.lower()).cast("int")).over(w)).where("valore is not null and record > 0").select("foglio", "record", "campo", "valore")


def relation_matrix(cells: DataFrame) -> DataFrame:
    """(foglio, a, rel, b) of a square sheet with units along both sides and signs in the cells.

    A sign without direction says that the row covers the column; the same relation from both sides comes once.
    """
    c = grid(cells)
    top = c.where("riga = 1 and colonna > 1").select("foglio", "colonna", unit_number(F.col("valore")).alias("cb"))
    side = c.where("colonna = 1 and riga > 1").select("foglio", "riga", unit_number(F.col("valore")).alias("ca"))
    body = c.where("riga > 1 and colonna > 1").join(top, ["foglio", "colonna"]).join(side, ["foglio", "riga"]).where("ca is not null and cb is not null and ca <> cb")
    r = relation_of(F.col("valore"))
    rel = F.coalesce(r["rel"], F.lit("copre"))
    swap = F.coalesce(r["inversa"], F.lit(False))
    e = body.select("foglio", F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("a"), rel.alias("rel"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("b"))
    same = F.col("rel").isin("uguale a", "si lega a")
    return e.select("foglio", F.when(same, F.least("a", "b")).otherwise(F.col("a")).alias("a"), "rel", F.when(same, F.greatest("a", "b")).otherwise(F.col("b")).alias("b")).distinct()


def report(cells: DataFrame) -> DataFrame:
    """(foglio, righe, testata, scartate) of each sheet: what the normaliser did to it."""
    c = grid(cells)
    head = header_rows(c)
    bad = dropped_rows(c, head).groupBy("foglio").agg(F.count(F.lit(1)).alias("scartate"))
    rows = c.groupBy("foglio").agg(F.countDistinct("riga").alias("righe"))
    return rows.join(head, "foglio", "left").join(bad, "foglio", "left").select("foglio", "righe", "testata", F.coalesce("scartate", F.lit(0)).alias("scartate"))
