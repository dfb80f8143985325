"""What a rewrite of each cluster would do, as rows: an action for each cluster and its parts. No source is changed here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.operators.variation import HIGH_CONFIDENCE


def gate(clusters: DataFrame, mode: str = "batch") -> DataFrame:
    """Adds action: refactor, review or skip. clusters: strategy, confidence, issues (an array). mode: batch, interactive or dry-run."""
    if mode not in ("batch", "interactive", "dry-run"):
        raise ValueError("mode must be batch, interactive or dry-run")
    unsafe = F.exists("issues", lambda x: ~x.startswith("warning"))
    weak = F.col("confidence") < F.lit(HIGH_CONFIDENCE) if mode == "batch" else F.lit(False)
    go = "review" if mode == "interactive" else "plan" if mode == "dry-run" else "refactor"
    return clusters.withColumn("action", F.when(F.col("strategy").isNull(), "skip").when(F.col("strategy") == "MANUAL_REVIEW_REQUIRED", "review").when(unsafe | weak, "skip").otherwise(F.lit(go)))


def constructor_master(constructors: DataFrame) -> DataFrame:
    """cluster_id, master: the constructor that others delegate to, the one with most parameters. constructors: cluster_id, id, n_params."""
    return constructors.groupBy("cluster_id").agg(F.max_by("id", F.struct("n_params", -F.col("id"))).alias("master"))


def parameterized_rows(values: DataFrame, least: int = 3) -> DataFrame:
    """cluster_id, rows: distinct literal rows of a test's members, of the commonest count of literals, where at least ``least`` are. values: cluster_id, id, literals."""
    sized = values.withColumn("size", F.size("literals"))
    common = sized.groupBy("cluster_id", "size").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.max_by("size", F.struct("n", "size")).alias("size"))
    kept = sized.join(common, ["cluster_id", "size"])
    return kept.groupBy("cluster_id").agg(F.array_sort(F.collect_set(F.array_join("literals", ","))).alias("rows")).where(F.size("rows") >= least)


def parent_class(classes: DataFrame) -> DataFrame:
    """cluster_id, parent: a name from the common suffix of the members' class names, or of the first. classes: cluster_id, class_name."""
    names = classes.groupBy("cluster_id").agg(F.array_sort(F.collect_set("class_name")).alias("names"))
    first = F.get("names", F.lit(0))
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.length(first)), lambda i: F.substr(first, i)), lambda end: F.forall("names", lambda n: n.endswith(end)) & end.rlike("^[A-Z]"))
    return names.select("cluster_id", F.concat(F.lit("Abstract"), F.coalesce(F.get(ends, F.lit(0)), first)).alias("parent"))


# Classes of shared static code, by how a method's name begins or what it holds.
UTILITIES = (("ValidationUtils", r"^(is|validate)"), ("StringUtils", "String|Format"), ("DateUtils", "Date|Time"), ("MathUtils", "Math|Calculate"))


def utility_class(clusters: DataFrame) -> DataFrame:
    """Adds utility: the class that shared static code moves to, null where a body uses ``this``. clusters: method_name, body."""
    kind = F.lit("CommonUtils")
    for name, pattern in reversed(UTILITIES):
        kind = F.when(F.col("method_name").rlike(pattern), name).otherwise(kind)
    return clusters.withColumn("utility", F.when(~F.col("body").rlike(r"\bthis\b"), kind))


def unused_methods(declared: DataFrame, called: DataFrame) -> DataFrame:
    """Private methods that no unit of their file calls. declared: file, name, is_private; called: file, name."""
    return declared.where("is_private").join(called.select("file", "name").distinct(), ["file", "name"], "left_anti")


def helper_methods(clusters: DataFrame) -> DataFrame:
    """Signatures of extracted helpers. clusters: cluster_id, method_name, return_type, params (name, type), body."""
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    nth = F.row_number().over(Window.partitionBy("method_name").orderBy("cluster_id"))
    name = F.when(nth == 1, F.col("method_name")).otherwise(F.concat("method_name", nth.cast("string")))
    return clusters.select("cluster_id", F.concat(F.lit("private "), "return_type", F.lit(" "), name, F.lit("("), params, F.lit(") {\n"), "body", F.lit("\n}")).alias("source"))


def is_test_class(file: str = "file", annotations: str | None = None):
    """Whether a file holds tests, by its name or its units' annotations."""
    named = F.col(file).rlike(r"(Test|Tests|IT)\.java$")
    return named | F.array_contains(annotations, "@Test") if annotations else named


def iterate(analysis, rewrite, most: int = 2):
    """Passes of analysis and rewrite until nothing is left to do, at most so many: analysis() gives clusters, rewrite(clusters) says how many it changed."""
    done = []
    for _ in range(most):
        changed = rewrite(analysis())
        done.append(changed)
        if not changed:
            break
    return done
