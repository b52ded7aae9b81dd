"""References to records that do not exist, and what hangs from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import skew_left_join

REASONS = ("mancante", "tardiva", "eliminata")


def one_row_per_unit(units: DataFrame, key: str = "num", since: str = "inserito", until: str = "eliminato") -> DataFrame:
    """Several records of one key: valid from the first entry until the last deletion, open if any record is."""
    return (
        units.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("num"))
        .agg(
            F.min(since).alias("inserito"),
            F.when(F.count(until) == F.count(F.lit(1)), F.max(until)).alias("eliminato"),
        )
    )


def orphan_references(refs: DataFrame, units: DataFrame) -> DataFrame:
    """Direct orphans: each reference in ``refs`` that has no valid record in ``units``.

    ``refs``: (tabella, campo, riga, ref, registrato) and any further columns, which are kept.
    ``units``: (num, inserito, eliminato), keys may repeat (see ``one_row_per_unit``).
    Adds ``motivo``: 'mancante' (no record), 'tardiva' (entered after the reference) or
    'eliminata' (deleted not after the reference), and ``periodo`` ('YYYY-MM').

    Null references are no references and never reported. A null ``registrato`` can only be
    'mancante' and has a null period. A record without ``inserito`` is never late, one without
    ``eliminato`` never deleted. Repeated rows are reported each. Empty units: all are missing.

    The reference side is shuffled once by key; keys holding a large share of the rows skip the
    shuffle (``skew_left_join``).
    """
    one = one_row_per_unit(units).select(
        F.col("num").alias("__num"), F.col("inserito").alias("__ins"), F.col("eliminato").alias("__eli")
    )
    joined = skew_left_join(refs.where(F.col("ref").isNotNull()), one, "ref", "__num")
    reason = (
        F.when(F.col("__num").isNull(), F.lit("mancante"))
        .when(F.col("__ins") > F.col("registrato"), F.lit("tardiva"))
        .when(F.col("__eli") <= F.col("registrato"), F.lit("eliminata"))
    )
    return (
        joined.withColumn("motivo", reason)
        .where(F.col("motivo").isNotNull())
        .withColumn("periodo", F.date_format("registrato", "yyyy-MM"))
        .drop("__num", "__ins", "__eli")
    )


#: Orphaned units that are broadcast to the references; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def orphan_cascade(refs: DataFrame, units: DataFrame, parents: DataFrame, levels: int | None = None) -> DataFrame:
    """Direct and inherited orphans by a fixpoint down the foreign-key graph: (tabella, campo, riga, motivo, periodo, livello).

    ``refs``: (tabella, campo, riga, ref, registrato, unita), ``unita`` being the unit that holds the reference
    (null where the row belongs to no unit). ``units``: (num, inserito, eliminato). ``parents``: (figlio,
    genitore), the rows by which a unit depends on another; a unit may depend on several.

    Level 0 are the direct orphans (``orphan_references``), and with ``levels`` = 0 the cascade ends there. A
    unit that holds one is orphaned, and so is, a level further, each unit that depends on an orphaned unit,
    until no unit is new (``inherited_levels``); cycles end, as a level never falls back. References to a unit
    orphaned at level n have livello n + 1 and motivo 'ereditata'; with ``levels`` = k those up to k are kept. A
    direct orphan is not repeated as inherited.
    """
    keys = ["tabella", "campo", "riga"]
    direct = orphan_references(refs, units)
    first = direct.select(*keys, "motivo", "periodo", F.lit(0).cast("bigint").alias("livello"))
    if levels == 0:
        return first
    direct = cut(direct)
    first = direct.select(*keys, "motivo", "periodo", F.lit(0).cast("bigint").alias("livello"))
    bad = inherited_levels(direct.select(F.col("unita").alias("num")), parents).select(F.col("num").alias("__n"), "livello")
    named = refs.where("ref is not null")
    if bad.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        named = named.join(F.broadcast(bad), F.col("ref") == F.col("__n"))
    else:
        named = skew_left_join(named, bad, "ref", "__n").where("__n is not null")
    inherited = named.select(*keys, F.lit("ereditata").alias("motivo"), F.date_format("registrato", "yyyy-MM").alias("periodo"), (F.col("livello") + 1).alias("livello")).join(direct.select(*keys), keys, "left_anti")
    return first.unionByName(inherited if levels is None else inherited.where(F.col("livello") <= levels))


def inherited_levels(seeds: DataFrame, parents: DataFrame) -> DataFrame:
    """(num, livello) of all units below the ``seeds`` (num): links to the nearest seed, 0 for the seeds themselves.

    Pointer doubling over one link a unit (the least parent): after k rounds each unit knows the nearest seed
    within 2 ** k links and its ancestor that far up, so rounds grow with the log of the depth and no pairs are
    made. If one round finds nothing nearer, none will, as all shorter distances occur on the way to a longer
    one. Units with several parents hand their further links in afterwards: where one gives a lower level, the
    unit becomes a seed of that level and the doubling runs again, until nothing falls.
    """
    links = cut(parents.where("figlio is not null and genitore is not null and figlio <> genitore").select("figlio", "genitore").distinct())
    one = links.groupBy("figlio").agg(F.min("genitore").alias("genitore"))
    more = cut(links.join(one.withColumnRenamed("genitore", "primo"), "figlio").where("genitore <> primo").select("figlio", "genitore"))
    seed = cut(seeds.where("num is not null").select("num").distinct().withColumn("livello", F.lit(0).cast("bigint")))
    while True:
        found = cut(_nearest_seed(one, seed).where("livello is not null"))
        if more.isEmpty():
            return found
        better = (
            more.join(found.withColumnRenamed("num", "genitore"), "genitore").groupBy(F.col("figlio").alias("num")).agg((F.min("livello") + 1).alias("l"))
            .join(found, "num", "left").where("livello is null or l < livello").select("num", F.col("l").alias("livello"))
        )
        better = cut(better)
        if better.isEmpty():
            return found
        seed = cut(found.unionByName(better).groupBy("num").agg(F.min("livello").alias("livello")))


def _nearest_seed(one: DataFrame, seed: DataFrame) -> DataFrame:
    """(num, livello): least livello of a seed on the way up plus the links to it; null if there is none."""
    s = seed.select(F.col("num").alias("__s"), F.col("livello").alias("__l"))
    every = one.select("figlio").unionByName(one.select(F.col("genitore").alias("figlio"))).unionByName(seed.select(F.col("num").alias("figlio"))).distinct()
    state = cut(
        every.join(one, "figlio", "left").join(s, F.col("figlio") == F.col("__s"), "left")
        .select(F.col("figlio").alias("num"), F.col("genitore").alias("su"), F.col("__l").alias("livello"), F.lit(True).alias("mosso"))
    )
    step = 1
    while True:
        # Who is at its root has looked at all its ancestors; the others look at the unit ``step`` links up.
        up = state.where("su is not null or livello is not null").select(F.col("num").alias("__u"), F.col("su").alias("__su"), F.col("livello").alias("__l"))
        low = F.least("livello", F.col("__l") + F.lit(step))
        state = cut(
            state.join(up, F.col("su") == F.col("__u"), "left").select("num", F.col("__su").alias("su"), low.alias("livello"), (F.coalesce(low, F.lit(-1)) != F.coalesce("livello", F.lit(-1))).alias("mosso"))
        )
        if state.where("mosso").isEmpty():
            return state.select("num", "livello")
        step *= 2


def orphan_report(cascade: DataFrame) -> DataFrame:
    """Counts per table, period and reason, direct and inherited apart."""
    return cascade.groupBy("tabella", "campo", "periodo", "motivo").agg(
        F.count(F.lit(1)).alias("righe"), F.max("livello").cast("bigint").alias("livello_max")
    )
