"""Variables of sequences: what is defined, used and needed afterwards; and the boundaries that follow from it.

Events are rows (seq_id, unit_idx, name, event), event one of declare, literal_init, assign, use, unary, return, internal. A
sequence's sets are arrays on one row, so all rules are set operations on arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variables(events: DataFrame) -> DataFrame:
    """Per sequence: defined, literal_init, internal, used, returned, modified; sorted arrays of names."""

    def names(*kinds: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("event").isin(*kinds), F.col("name"))))

    return events.groupBy("seq_id").agg(
        names("declare", "literal_init", "internal").alias("defined"), names("literal_init").alias("literal_init"), names("internal").alias("internal"),
        names("use").alias("used"), names("return").alias("returned"), names("assign", "unary").alias("modified"),
    )


def used_after(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """(seq_id, after): names used in the container behind the sequence's end. sequences: seq_id, container_id, end_idx; events: container_id, unit_idx, name, event."""
    s, e = sequences.alias("s"), events.where(F.col("event").isin("use", "assign", "unary", "return")).alias("e")
    later = s.join(e, (F.col("s.container_id") == F.col("e.container_id")) & (F.col("e.unit_idx") > F.col("s.end_idx")), "left")
    return later.groupBy("s.seq_id").agg(F.array_sort(F.collect_set("e.name")).alias("after"))


def live_out(defined: Column, after: Column, literal_init: Column, internal: Column) -> Column:
    """Names that a sequence defines and later units need; literals can be declared again, internal names aren't seen outside."""
    return F.array_except(F.array_except(F.array_intersect(defined, after), literal_init), internal)


def captured(used: Column, defined: Column) -> Column:
    return F.array_except(used, defined)


def escaping(modified: Column, defined: Column) -> Column:
    """Names that are changed here but declared elsewhere."""
    return F.array_except(modified, defined)


# Types whose variables hold plain values.
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "String")


def return_variable(live: Column, types: Column, wanted: Column) -> Column:
    """The variable that an extraction returns: the only live one; else the first of an object type; else, without live ones, the only one of the wanted type.

    types: map from name to type.
    """
    objects = F.filter(live, lambda v: ~F.coalesce(types[v].isin(*PRIMITIVES), F.lit(False)))
    fitting = F.filter(F.map_keys(types), lambda v: types[v] == wanted)
    return F.when(F.size(live) == 1, F.get(live, F.lit(0))).when(F.size(objects) > 0, F.get(objects, F.lit(0))).when((F.size(live) == 0) & (F.size(fitting) == 1), F.get(fitting, F.lit(0)))


def safe(live: Column, returns: Column, kind: Column) -> Column:
    """Nothing live for void, otherwise something to return."""
    return F.when(kind == "void", F.size(live) == 0).otherwise(returns.isNotNull())


def usage_only(unit: Column, defined: Column) -> Column:
    """unit: struct with is_expression, changes, used. An expression that changes nothing and uses defined names alone, at least one."""
    return unit["is_expression"] & ~unit["changes"] & (F.size(unit["used"]) > 0) & (F.size(F.array_except(unit["used"], defined)) == 0)


def tail_trim(units: Column, defined: Column, min_units: int = 5) -> Column:
    """How many units stay once usage-only ones at the end go, never fewer than min_units; all where nothing is defined."""
    def step(kept: Column, u: Column) -> Column:
        # kept: (n, whether the end is still being cut)
        cut = kept["open"] & (kept["n"] > min_units) & usage_only(u, defined)
        return F.struct(F.when(cut, kept["n"] - 1).otherwise(kept["n"]).alias("n"), cut.alias("open"))

    kept = F.aggregate(F.reverse(units), F.struct(F.size(units).alias("n"), F.lit(True).alias("open")), step, lambda k: k["n"])
    return F.when((F.size(defined) == 0) | (F.size(units) <= min_units), F.size(units)).otherwise(kept)


def head_extension(before: Column, names: Column) -> Column:
    """How many units directly before a sequence declare captured names, without a gap. before: arrays of declared names, in order."""
    def step(a: Column, declared: Column) -> Column:
        more = a["open"] & (F.size(F.array_intersect(declared, names)) > 0)
        return F.struct((a["n"] + more.cast("int")).alias("n"), more.alias("open"))

    return F.aggregate(F.reverse(before), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), step, lambda a: a["n"])


def refined(kept: Column, rescored: Column, min_units: int, threshold: float) -> Column:
    """Whether a refined pair takes the place of its original."""
    return (kept >= min_units) & (rescored >= threshold)


def in_scope(params: Column, fields: Column, locals_before: Column) -> Column:
    return F.array_distinct(F.concat(params, fields, locals_before))


# Types that are safe to share between tests, and annotations' words for mocks.
IMMUTABLE = (
    "String", "Integer", "int", "Long", "long", "Double", "double", "Float", "float", "Boolean", "boolean", "Character", "char", "Byte", "byte", "Short", "short",
    "BigDecimal", "BigInteger", "LocalDate", "LocalDateTime", "LocalTime", "Instant", "Duration", "Period", "ZonedDateTime", "OffsetDateTime", "UUID", "URI", "URL", "Path",
    "ImmutableList", "ImmutableSet", "ImmutableMap", "Database", "Connection",
)
MOCKS = ("Mock", "Spy", "InjectMocks", "Captor")


def mutability(kind: Column, name: Column) -> Column:
    """immutable, mock or mutable, by a variable's type (without its type arguments) and name."""
    plain = F.regexp_replace(kind, "<.*$", "").isin(*IMMUTABLE)
    return F.when(plain, "immutable").when(kind.rlike("|".join(MOCKS)) | F.lower(name).rlike("mock|stub|spy"), "mock").otherwise("mutable")


# --- over arrays of the events of units, as the code adapter makes them ---------------------------------------------------------


def gathered(events: Column, *fields: str) -> Column:
    """The distinct names in these fields of all units."""
    def each(field: str) -> Column:
        return F.transform(events, lambda e: e[field])

    return F.array_distinct(F.flatten(F.concat(*map(each, fields))))


def defined_in(events: Column) -> Column:
    return gathered(events, "declared", "assigned", "internal")


def live_out_of(events: Column, after: Column) -> Column:
    return live_out(defined_in(events), after, gathered(events, "literal_init"), gathered(events, "internal"))


def types_of(events: Column) -> Column:
    """Map from declared name to type; the first declaration counts."""
    pairs = F.flatten(F.transform(events, lambda e: F.arrays_zip(e["declared"].alias("name"), e["types"].alias("type"))))
    entries = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["name"])), lambda n: F.struct(n, F.get(F.filter(pairs, lambda p: p["name"] == n), F.lit(0))["type"]))
    return F.map_from_entries(entries)


def trimmed(events: Column, min_units: int) -> Column:
    """tail_trim over units' events."""
    units = F.transform(events, lambda e: F.struct(e["is_expression"].alias("is_expression"), (F.size(e["declared"]) + F.size(e["assigned"]) + F.size(e["unary"]) > 0).alias("changes"), e["used"].alias("used")))
    return tail_trim(units, defined_in(events), min_units)
