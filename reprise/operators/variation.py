"""What differs between the members of a cluster, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differences(a: Column, b: Column) -> Column:
    """(pos, v1, v2) of the places where two arrays differ, in order; missing places are null."""
    zipped = F.arrays_zip(a.alias("v1"), b.alias("v2"))
    placed = F.transform(zipped, lambda x, i: F.struct(i.alias("pos"), x["v1"].alias("v1"), x["v2"].alias("v2")))
    return F.filter(placed, lambda x: ~x["v1"].eqNullSafe(x["v2"]))


def different(a: Column, b: Column, most: int) -> Column:
    """(pos, v2) of the places where two arrays of one size, of at most ``most`` elements, differ, and null for the others; without a lambda."""
    return F.array(*[F.when(F.get(a, F.lit(i)) != F.get(b, F.lit(i)), F.struct(F.lit(i).alias("pos"), F.get(b, F.lit(i)).alias("v2"))) for i in range(most)])


def differing(a: Column, b: Column, most: int) -> Column:
    """The places where two arrays of one size, of at most ``most`` (up to 31) elements, differ, as bits; without a lambda, which costs far more."""
    return sum((F.coalesce((F.get(a, F.lit(i)) != F.get(b, F.lit(i))).cast("int"), F.lit(0)) * (1 << i) for i in range(most)), F.lit(0))


def outermost(variations: DataFrame) -> DataFrame:
    """Without variations that hold another one of their pair. variations: pair_id, start, end."""
    outer, inner = variations.alias("o"), variations.select("pair_id", F.col("start").alias("s"), F.col("end").alias("e")).alias("i")
    holds = (F.col("o.pair_id") == F.col("i.pair_id")) & (F.col("o.start") <= F.col("s")) & (F.col("e") <= F.col("o.end")) & ((F.col("o.start") < F.col("s")) | (F.col("e") < F.col("o.end")))
    return outer.join(inner, holds, "left_anti")


def aggregate(member_variations: DataFrame) -> DataFrame:
    """By cluster and position: the first member's values, all bindings, distinct values. member_variations: cluster_id, id, pos, v1, v2."""
    return member_variations.groupBy("cluster_id", "pos").agg(
        F.min_by(F.struct("v1", "v2"), "id").alias("first"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "v2")))).alias("bindings"), F.count_distinct("v2").alias("n_values")
    )


def parameter_type(value: Column) -> Column:
    """A literal's type, by its look."""
    return (
        F.when(value.rlike(r'^".*"$'), "String").when(value.rlike(r"^(true|false)$"), "boolean").when(value.rlike(r"^-?[0-9]+[lL]$"), "long")
        .when(value.rlike(r"^-?[0-9]+\.[0-9]+$"), "double").when(value.rlike(r"^-?[0-9]+$"), "int").otherwise("Object")
    )


# Default names of parameters by type.
NAMES = {"String": "str", "int": "num", "long": "longValue", "double": "doubleValue", "boolean": "flag"}


def parameter_name(kind: Column) -> Column:
    out = F.lit("param")
    for k, v in NAMES.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def truncation(*limits: Column) -> Column:
    """How many units stay valid: the least limit that there is, or -1 for all."""
    return F.coalesce(F.least(*limits, F.lit(None).cast("int")), F.lit(-1)) if limits else F.lit(-1)


def return_type(kinds: Column) -> Column:
    """One type for several: an object type before double, long, int, any other."""
    rank = F.transform(kinds, lambda k: F.struct(F.when(k == "void", 0).when(k == "int", 2).when(k == "long", 3).when(k == "double", 4).when(k.rlike("^[A-Z]"), 5).otherwise(1).alias("rank"), k.alias("kind")))
    return F.coalesce(F.array_max(rank)["kind"], F.lit("void"))


def strategy(nested_return: Column, one_class_constructors: Column, master: Column, cross_file: Column, all_full: Column, static: Column, all_tests: Column, n_members: Column, truncated: Column, n_params: Column) -> Column:
    """What a cluster calls for. Conditions are of the whole cluster; cross_file: over one file."""
    return (
        F.when(nested_return, "MANUAL_REVIEW_REQUIRED")
        .when(one_class_constructors & master & ~cross_file, "CONSTRUCTOR_DELEGATION")
        .when(cross_file & ~all_full, "EXTRACT_HELPER_METHOD")
        .when(cross_file & ~static, "EXTRACT_PARENT_CLASS")
        .when(cross_file, "EXTRACT_TO_UTILITY_CLASS")
        .when(all_tests & (n_members >= 3) & ~truncated & (n_params <= 7), "EXTRACT_TO_PARAMETERIZED_TEST")
        .otherwise("EXTRACT_HELPER_METHOD")
    )


HIGH_CONFIDENCE = 0.50


def confidence(n_params: Column, avg_similarity: Column, n_live_out: Column, valid_units: Column) -> Column:
    """1, less for many parameters, weak similarity and several results; 0 where nothing is valid."""
    value = F.when(n_params > 5, F.lit(0.7)).otherwise(F.lit(1.0)) * F.when(avg_similarity < 0.85, F.lit(0.8)).otherwise(F.lit(1.0)) * F.when(n_live_out > 1, F.lit(0.1)).otherwise(F.lit(1.0))
    return F.when(valid_units == 0, F.lit(0.0)).otherwise(value)


def safety_issues(name_taken: Column, escapes: Column, control_flow: Column, n_params: Column, final_fields: Column, nested_type: Column) -> Column:
    """What speaks against an extraction; an entry that begins with ``warning`` doesn't forbid it."""
    checks = ((name_taken, "name is taken"), (escapes > 0, "variables escape"), (control_flow, "control flow differs"), (n_params > 5, "warning: many parameters"), (final_fields, "final field is assigned"), (nested_type, "type is nested"))
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def unique_names(rows: DataFrame, scope: str, name: str) -> DataFrame:
    """Adds unique_name: the second and later uses of a name in a scope get a number. rows: also id, which orders them."""
    nth = F.row_number().over(Window.partitionBy(scope, name).orderBy("id"))
    return rows.withColumn("unique_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), nth.cast("string"))))


def semantic_name(first_unit: Column, fallback: Column) -> Column:
    """A verb and an object from the first call or assignment of a body: ``a.setName(x)`` gives setName, ``total = ..`` computeTotal."""
    call, made = F.regexp_extract(first_unit, r"([a-z][A-Za-z0-9]*)\s*\(", 1), F.regexp_extract(first_unit, r"([a-z][A-Za-z0-9]*)\s*=[^=]", 1)
    capital = F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, 2, 1000))
    return F.when(made != "", F.concat(F.lit("compute"), capital)).when(call != "", call).otherwise(fallback)
