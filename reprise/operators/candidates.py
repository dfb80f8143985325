"""Candidate pairs of window classes that can pass the structural filter.

A class is a row (class_id, n, norm_h, fuzzy_h): the hashes of its units' two normal forms; without fuzzy_h they are the same. Both ways carry them into the join and
verify there, so only pairs that pass come out, each once, and nothing has to be fetched again for scoring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.operators import lsh, similarity
from reprise.storage import discard, materialize, release

#: Windows of up to so many units are compared by bits.
_SHORT = 10


def needed(n: Column, least: float) -> Column:
    """How many equal places two windows of n units need."""
    return F.ceil(n * F.lit(least) - F.lit(1e-9)).cast("int")


def equal_places(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _equal(a: Column, b: Column) -> Column:
    """The equal places of two short windows, as bits."""
    return similarity.equal_bits(a, b, _SHORT)


def _places(rows: str) -> Column:
    """The places (at) of an array, as bits."""
    return F.aggregate(rows, F.lit(0), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["at"])))


def holding(classes: DataFrame, least: float) -> DataFrame:
    """(class_id, n, r): the classes that have enough places in common with others to be in a pair, with those places (c, at, unit), rarest first.

    ``c`` classes of the size have the unit at that place. What no other class has can't be an equal place, so all other classes are in no pair.
    """
    places = classes.select("class_id", "n", F.posexplode(_fuzzy(classes)).alias("at", "unit"))
    common = materialize(places.groupBy("n", "at", "unit").agg(F.count("*").alias("c")).where("c > 1"), "units")
    release(classes.sparkSession)
    found = places.join(common, ["n", "at", "unit"]).groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "at", "unit"))).alias("r"))
    out = materialize(found.where(F.size("r") >= needed(F.col("n"), least)), "places")
    discard(common)
    release(classes.sparkSession)
    return out


def _fuzzy(classes: DataFrame) -> str:
    return "fuzzy_h" if "fuzzy_h" in classes.columns else "norm_h"


def _carried(classes: DataFrame, more: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(("norm_h", _fuzzy(classes), *more)))


def _met(rows: DataFrame, least: float, carried: tuple[str, ...], fuzzy: str, *keys: str) -> DataFrame:
    """Pairs of rows (class_id, n, all, carried, keys) that agree in n and the keys and pass the filter."""
    a, b = (rows.select("n", *keys, F.col("class_id").alias(f"id{k}"), *(F.col(c).alias(f"{c}{k}") for c in (*carried, "all"))) for k in (1, 2))
    met = a.join(b, ["n", *keys]).where("id1 < id2")
    a, b = F.col(f"{fuzzy}1"), F.col(f"{fuzzy}2")
    return met.where(F.when(F.col("n") <= _SHORT, F.bit_count(_equal(a, b))).otherwise(equal_places(a, b)) >= needed(F.col("n"), least))


def _out(met: DataFrame, more: tuple[str, ...]) -> DataFrame:
    return met.select("id1", "id2", "n", "norm_h1", "norm_h2", *(f"{c}{k}" for c in more for k in (1, 2)))


def exhaustive(classes: DataFrame, least: float = 0.5, more: tuple[str, ...] = (), add: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id1, id2, n, norm_h1, norm_h2): all pairs of one size with at least that share of places equal; none is lost.

    Two windows with k equal places, of m that other windows share, have one of the m - k + 1 of those in common that are rarest over all classes, so classes
    meet by those alone, and a unit that many windows have brings only those together that have no rarer one. ``more``: columns of
    the classes that pairs carry as well, with a 1 or 2 behind their names, so that pairs need no further join. ``add`` gives classes those
    of them that begin with ``added``, once classes that meet nobody are out.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    carried, fuzzy = _carried(classes, tuple(c for c in more if c != "shared")), _fuzzy(classes)
    ranked = holding(classes, least)
    also = [_places("r").alias("shared")] if "shared" in more else []
    rarest = ranked.select("class_id", "n", *also, F.explode(F.slice("r", F.lit(1), F.size("r") - needed(F.col("n"), least) + 1)).alias("x")).select("class_id", "n", *(["shared"] if also else []), "x.at", "x.unit")
    # places where only one class would come are left out before arrays are carried
    keys = materialize(rarest.groupBy("n", "at", "unit").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "keys")
    release(classes.sparkSession)
    own = rarest.join(keys, ["n", "at", "unit"], "left_semi").groupBy("class_id").agg(F.collect_list(F.struct("at", "unit")).alias("r"), *([F.min("shared").alias("shared")] if also else []))
    rows = classes.select("class_id", "n", *(c for c in carried if not c.startswith("added"))).join(own, "class_id")
    rows = materialize(add(rows) if add else rows, "rows")
    for old in (keys, ranked):
        discard(old)
    release(classes.sparkSession)
    # both kinds of places in one column, as both sides of the join have to carry the same for one shuffle to serve them
    places = _places("r").bitwiseOR(F.shiftleft("shared", _SHORT)) if also else _places("r")
    rows = rows.select("class_id", "n", *carried, F.when(F.col("n") > _SHORT, F.transform("r", lambda x: x["at"])).alias("all"), F.explode("r").alias("x"), places.alias("bits"))
    met = _met(rows.select("class_id", "n", *carried, "all", "bits", "x.at", "x.unit"), least, (*carried, "bits"), fuzzy, "at", "unit")
    # a pair meets at every equal place that is among the rarest of both; it is taken at the first
    shared = F.filter(F.array_intersect("all1", "all2"), lambda p: F.get(f"{fuzzy}1", p) == F.get(f"{fuzzy}2", p))
    bits = F.col("bits1").bitwiseAND(F.col("bits2")).bitwiseAND(_equal(F.col(f"{fuzzy}1"), F.col(f"{fuzzy}2")))
    first = F.when(F.col("n") <= _SHORT, bits.bitwiseAND(-bits) == F.call_function("shiftleft", F.lit(1), F.col("at"))).otherwise(F.array_min(shared) == F.col("at"))
    met = met.where(first)
    return _out(met.withColumns({f"shared{k}": F.shiftright(f"bits{k}", _SHORT) for k in (1, 2)}) if also else met, more)


def by_lsh(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], bands: int = 25, rows_per_band: int = 4, least: float = 0.5, more: tuple[str, ...] = ()) -> DataFrame:
    """(id1, id2, n, norm_h1, norm_h2): pairs of one size that share a bucket and pass. texts: gives classes their class_id and tokens (an array of units).

    Classes without enough places in common with others can't pass and get no signature; those that are alone in all their buckets are left
    out before any arrays are carried. ``more``: as in ``exhaustive``.
    """
    carried, fuzzy = _carried(classes, more), _fuzzy(classes)
    held = holding(classes, least) if least > 0 else None
    some = classes.join(held.select("class_id"), "class_id") if held else classes
    buckets = lsh.bucket_rows(texts(some), "class_id", "tokens", bands, rows_per_band)
    # sizes are part of the join, so buckets may be of several
    buckets = materialize(buckets.select("class_id", F.xxhash64("bucket", "band").alias("bucket")), "buckets")
    release(classes.sparkSession)
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"), "shared")
    release(classes.sparkSession)
    own = materialize(buckets.join(shared, "bucket").groupBy("class_id").agg(F.collect_list("bucket").alias("all")), "own")
    for old in (buckets, shared, *([held] if held else [])):
        discard(old)
    release(classes.sparkSession)
    if least > 0:
        # what shares a bucket is known; those that also pass meet by their rarest places, of which a class has fewer than buckets
        both = exhaustive(classes.join(own.withColumnRenamed("all", "buckets"), "class_id"), least, (*more, "buckets"))
        discard(own)
        return both.where(F.arrays_overlap("buckets1", "buckets2")).drop("buckets1", "buckets2")
    rows = own.join(classes.select("class_id", "n", *carried), "class_id").select("class_id", "n", *carried, "all", F.explode("all").alias("bucket"))
    met = _met(rows, least, carried, fuzzy, "bucket")
    return _out(met.where(F.array_min(F.array_intersect("all1", "all2")) == F.col("bucket")), more)
