"""The analysis of Java sources, with the boundaries of pairs refined, and what each cluster calls for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.config import Settings
from reprise.operators import dataflow, reports, similarity, variation
from reprise.plans import analysis, rewrites
from reprise.sources import java, tables
from reprise.storage import materialize


def bodies(sources: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Bodies of all targeted files that no exclude glob meets. sources: file, text."""
    s = settings or Settings()
    kept = sources.where(F.col("file").isNotNull() & ~tables.excluded(F.col("file"), s.exclude)).dropDuplicates(["file"])
    return java.java_bodies(kept).where(tables.targeted(F.col("class_name"), s.target))


def _cut(array: str, offset: Column, n: Column) -> Column:
    return F.slice(array, offset + 1, n)


def refiner(s: Settings) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Trim units that only use names off the ends of pairs, and take the declarations of captured names in at their heads.

    A pair is scored anew, sizes may differ then, and takes the place of its original only if neither side falls below min_units and the score
    not below the threshold. Heads grow in the top block of a body alone.
    """

    def refine(placed: DataFrame, rows: DataFrame) -> DataFrame:
        key = placed.columns
        out = placed
        for k in (1, 2):
            side = rows.select(F.col("container_id").alias(f"box{k}"), F.col("block_no").alias(f"block{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("events", "norm", "starts", "ends")))
            out = out.join(side, [f"box{k}", f"block{k}"])
            own = _cut(f"events{k}", F.col(f"offset{k}"), F.col(f"n{k}"))
            out = out.withColumn(f"_own{k}", own)
            names = dataflow.captured(dataflow.gathered(F.col(f"_own{k}"), "used"), dataflow.defined_in(F.col(f"_own{k}")))
            before = F.transform(F.slice(f"events{k}", F.lit(1), F.col(f"offset{k}")), lambda e: e["declared"])
            out = out.withColumn(f"_kept{k}", dataflow.trimmed(F.col(f"_own{k}"), s.min_units))
            out = out.withColumn(f"_head{k}", F.when(F.col(f"block{k}") == 0, dataflow.head_extension(before, names)).otherwise(F.lit(0)))
            out = out.withColumn(f"_offset{k}", F.col(f"offset{k}") - F.col(f"_head{k}")).withColumn(f"_n{k}", F.col(f"_kept{k}") + F.col(f"_head{k}"))
            out = out.withColumn(f"_norm{k}", F.transform(_cut(f"norm{k}", F.col(f"_offset{k}"), F.col(f"_n{k}")), lambda u: F.xxhash64(u)))
        again = similarity.score_pairs(out.drop("lcs", "lev", "positional", "can_refactor").withColumnRenamed("overall", "_before").drop("events1", "events2", "norm1", "norm2", "_own1", "_own2"), "_norm1", "_norm2")
        better = dataflow.refined(F.least("_kept1", "_kept2"), F.col("overall"), s.min_units, s.threshold) & ((F.col("_n1") != F.col("n1")) | (F.col("_n2") != F.col("n2")))
        new = {"overall": F.when(better, F.col("overall")).otherwise(F.col("_before"))}
        for k in (1, 2):
            offset, n = (F.when(better, F.col(f"_{c}{k}")).otherwise(F.col(f"{c}{k}")) for c in ("offset", "n"))
            new |= {f"offset{k}": offset.cast("int"), f"n{k}": n.cast("int"), f"start{k}": F.element_at(f"starts{k}", offset + 1), f"end{k}": F.element_at(f"ends{k}", offset + n)}
            new[f"id{k}"] = F.xxhash64(f"box{k}", f"block{k}", offset.cast("int"), n.cast("int"))
        return again.select(*[new.get(c, F.col(c)).alias(c) for c in key])

    return refine


def analyse(sources: DataFrame, settings: Settings | None = None) -> analysis.Analysis:
    """Near-duplicate code of sources (file, text): bodies, windows, scores, refined boundaries, clusters."""
    s = settings or Settings()
    return analysis.analyse(materialize(bodies(sources, s), "bodies"), s, refiner(s))


def member_traits(found: analysis.Analysis) -> DataFrame:
    """Per sequence of a cluster: where it lies, its units' parts, what it defines, captures, leaves alive and lets escape."""
    code = found.bodies
    # copies of a box are members of their own here: their literals may differ
    held = found.members.join(found.boxes.select("container_id", "box"), "box").withColumn("id", F.xxhash64("container_id", "block_no", "start_offset", "n"))
    rows = held.join(code, ["container_id", "block_no"])
    top = code.where("block_no = 0").select("container_id", F.col("events").alias("top_events"), F.col("starts").alias("top_starts"))
    rows = rows.join(top, "container_id").withColumn("own", _cut("events", F.col("start_offset"), F.col("n")))
    later = F.filter(F.transform("top_events", lambda e, i: F.when(F.get("top_starts", i) > F.col("end_line"), e)), lambda e: e.isNotNull())
    rest = F.slice("events", F.col("start_offset") + F.col("n") + 1, F.greatest(F.lit(0), F.size("events") - F.col("start_offset") - F.col("n")))
    rows = rows.withColumn("after", dataflow.gathered(F.concat(rest, later), "used"))
    own = F.col("own")
    return rows.select(
        "cluster_id", "id", "container_id", "block_no", "start_offset", "n", "start_line", "end_line", "file", "kind", "class_name", "name", "is_static", "is_test", "params", "param_types",
        _cut("parts", F.col("start_offset"), F.col("n")).alias("parts"), _cut("fuzzy", F.col("start_offset"), F.col("n")).alias("fuzzy"), _cut("units", F.col("start_offset"), F.col("n")).alias("units"), "own",
        (F.size("units") == F.col("n")).alias("whole"), dataflow.live_out_of(own, F.col("after")).alias("live"), dataflow.gathered(own, "returned").alias("returned"),
        dataflow.captured(dataflow.gathered(own, "used"), dataflow.defined_in(own)).alias("captured"), dataflow.escaping(dataflow.gathered(own, "assigned", "unary"), dataflow.gathered(own, "declared")).alias("escapes"),
        dataflow.types_of(own).alias("types"), "after",
    )


def variations(traits: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, id, pos, v1, v2, type): where a member's parts differ from the primary's; pos is the unit's place << 16 + the part's place.

    Units whose parts don't align part by part differ as a whole, at part 0. Types are those of literals, or of names by declaration and parameter, or Object.
    """
    first = traits.join(clusters.select("cluster_id", F.col("primary_id").alias("id")), ["cluster_id", "id"]).select("cluster_id", F.col("parts").alias("p1"), F.col("types").alias("t1"), F.map_from_entries(F.arrays_zip("params", "param_types")).alias("q1"))
    both = traits.join(clusters.select("cluster_id", F.col("primary_id")), "cluster_id").where("id <> primary_id").join(first, "cluster_id")
    units = both.select("cluster_id", "id", "t1", "q1", F.posexplode(F.arrays_zip(F.col("p1"), F.col("parts").alias("p2"))).alias("unit", "z")).where("z.p1 is not null and z.p2 is not null")
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.array_join("z.p1", " ").alias("v1"), F.array_join("z.p2", " ").alias("v2")))
    found = F.when(F.size("z.p1") == F.size("z.p2"), variation.differences(F.col("z.p1"), F.col("z.p2"))).otherwise(whole)
    rows = units.select("cluster_id", "id", "unit", "t1", "q1", F.explode(found).alias("x"))
    literal = variation.parameter_type(F.col("x.v1"))
    kind = F.when(literal != "Object", literal).otherwise(F.coalesce(F.get(F.array(F.col("t1")[F.col("x.v1")]), F.lit(0)), F.col("q1")[F.col("x.v1")], F.lit("Object")))
    return rows.select("cluster_id", "id", (F.shiftleft("unit", 16) + F.col("x.pos")).alias("pos"), "x.v1", "x.v2", kind.alias("type"))


def recommend(found: analysis.Analysis) -> DataFrame:
    """Per cluster: strategy, method_name, params, return_type, return_variable, valid_units (-1: all), confidence, issues, files, and the cluster's figures.

    valid_units ends before the first unit that nests a return, that differs in form between members, or with which more than one variable is live for some member.
    Captured names and varying literals are parameters; names that a member declares itself aren't.
    """
    traits = materialize(member_traits(found), "traits")
    clusters = found.clusters
    primary = traits.join(clusters.select("cluster_id", F.col("primary_id").alias("id")), ["cluster_id", "id"])
    differ = materialize(variations(traits, clusters), "variations")

    form = traits.join(primary.select("cluster_id", F.col("fuzzy").alias("form")), "cluster_id")
    unlike = F.array_min(F.filter(F.transform("fuzzy", lambda u, i: F.when(u != F.get("form", i), i)), lambda i: i.isNotNull()))
    nested = F.array_min(F.filter(F.transform("own", lambda e, i: F.when(e["nested_return"], i)), lambda i: i.isNotNull()))

    def live_prefix(k: Column) -> Column:
        rest = dataflow.gathered(F.slice("own", k + 1, F.greatest(F.lit(0), F.col("n") - k)), "used")
        return F.size(dataflow.live_out_of(F.slice("own", F.lit(1), k), F.concat(rest, F.col("after")))) <= 1

    fits = F.array_max(F.filter(F.sequence(F.lit(1), F.col("n")), live_prefix))
    limits = form.select("cluster_id", "n", unlike.alias("unlike"), nested.alias("nested"), F.when(fits < F.col("n"), fits).alias("fits"))
    ends = limits.groupBy("cluster_id").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.min("unlike").alias("unlike"), F.min("nested").alias("nested"), F.min("fits").alias("fits"))
    short = F.when(F.col("shortest") < F.col("longest"), F.col("shortest"))
    ends = ends.select("cluster_id", variation.truncation(short, F.col("unlike"), F.col("nested"), F.col("fits")).alias("valid_units"), F.col("nested").isNotNull().alias("nested_return"))

    whole = traits.groupBy("cluster_id").agg(
        F.count_distinct("file").alias("n_files"), F.count_distinct("class_name", "file").alias("n_classes"), F.bool_and("whole").alias("all_full"), F.bool_and("is_test").alias("all_tests"),
        F.bool_and((F.col("kind") == "constructor") & (F.col("start_offset") == 0) & (F.col("block_no") == 0)).alias("constructors"), F.bool_or(F.col("whole") & (F.col("block_no") == 0)).alias("master"),
        F.max(F.size("live")).alias("n_live"), F.max(F.size("escapes")).alias("n_escapes"), F.count("*").alias("members"), F.array_sort(F.collect_set("file")).alias("files"),
    )
    inside = F.shiftright("pos", 16)
    used = differ.join(ends.select("cluster_id", "valid_units"), "cluster_id").where((F.col("valid_units") < 0) | (inside < F.col("valid_units")))
    # places that vary alike in every member are one parameter
    bound = used.groupBy("cluster_id", "pos").agg(F.first("v1").alias("v1"), F.first("type").alias("type"), F.to_json(F.array_sort(F.collect_set(F.struct("id", "v2")))).alias("bindings"))
    bound = bound.groupBy("cluster_id", "v1", "type", "bindings").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("cluster_id", "base").orderBy("pos"))
    named = bound.withColumn("base", F.when(F.col("v1").rlike("^[a-z][A-Za-z0-9_]*$") & ~F.col("v1").isin("true", "false", "null"), F.col("v1")).otherwise(variation.parameter_name(F.col("type"))))
    named = named.withColumn("name", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", nth.cast("string"))))
    varying = named.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"))).alias("varying"))

    own = primary.select("cluster_id", F.col("file").alias("primary_file"), "class_name", "is_static", "live", "types", "captured", "params", "param_types", "returned", "units", F.map_from_entries(F.arrays_zip("params", "param_types")).alias("scope"))
    rows = clusters.join(whole, "cluster_id").join(ends, "cluster_id").join(own, "cluster_id").join(varying, "cluster_id", "left")
    held = F.filter("captured", lambda c: F.array_contains("params", c))  # fields stay fields; parameters of the method are passed on
    passed = F.transform(held, lambda c: F.struct(c.alias("name"), F.coalesce(F.col("scope")[c], F.lit("Object")).alias("type")))
    varying_ = F.coalesce("varying", F.array().cast("array<struct<name:string,type:string>>"))
    rows = rows.withColumn("params_out", F.concat(F.filter(passed, lambda p: ~F.exists(varying_, lambda v: v["name"] == p["name"])), varying_))
    returns = dataflow.return_variable(F.col("live"), F.col("types"), F.lit(None).cast("string"))
    kind = variation.strategy(F.col("nested_return"), F.col("constructors") & (F.col("n_classes") == 1), F.col("master"), F.col("n_files") > 1, F.col("all_full"), F.col("is_static"), F.col("all_tests"), F.col("members"), F.col("valid_units") >= 0, F.size("params_out"))
    rows = rows.withColumn("return_variable", returns).withColumn("strategy", F.when(F.col("valid_units") == 0, "EXTRACT_HELPER_METHOD").otherwise(kind))
    rows = rows.withColumn("confidence", variation.confidence(F.size("params_out"), F.col("avg_similarity"), F.col("n_live"), F.col("valid_units")))
    rows = rows.withColumn("return_type", F.when(F.col("return_variable").isNull(), "void").otherwise(variation.return_type(F.array(F.coalesce(F.col("types")[F.col("return_variable")], F.lit("Object"))))))
    getter = F.concat(F.lit("get"), F.upper(F.substring("return_variable", 1, 1)), F.substring("return_variable", 2, 1000))
    name = F.when(F.col("return_variable").isNotNull(), getter).otherwise(variation.semantic_name(F.get("units", F.lit(0)), F.lit("extractedMethod")))
    rows = variation.unique_names(rows.withColumn("base_name", name).withColumn("id", F.col("primary_id")), "class_name", "base_name")
    no = F.lit(False)
    issues = variation.safety_issues(no, F.col("n_escapes"), no, F.size("params_out"), no, no)
    loc = F.when(F.col("valid_units") == 0, F.lit(0)).otherwise(F.col("loc_reduction"))
    return rows.select(
        "cluster_id", "primary_id", "primary_file", "class_name", "files", "n_members", "n_sequences", "n_pairs", loc.alias("loc_reduction"), "avg_similarity", "strategy", F.col("unique_name").alias("method_name"),
        F.col("params_out").alias("params"), "return_type", "return_variable", "valid_units", "confidence", issues.alias("issues"), F.array_join("units", "\n").alias("body"),
    )


def report(found: analysis.Analysis, plans: DataFrame) -> DataFrame:
    """The whole report by file: duplicates, similarity, clusters, savings, strategies, sequences and candidates."""
    files = found.bodies.select("file").distinct()
    own = analysis.cluster_files(found).join(plans.select("cluster_id", "loc_reduction", "strategy"), "cluster_id")
    return reports.file_report(files, analysis.pair_files(found), own, found.sequences.select("file"), found.pairs.count())


def actions(plans: DataFrame, mode: str = "batch") -> DataFrame:
    """Plans with action and, for helper methods, the source of the method that would be made."""
    gated = rewrites.gate(plans, mode)
    return gated.join(rewrites.helper_methods(gated.where("strategy = 'EXTRACT_HELPER_METHOD'")), "cluster_id", "left")
