"""Reports by file and project, and their outputs."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_report(files: DataFrame, pairs: DataFrame, clusters: DataFrame | None = None, sequences: DataFrame | None = None, candidates: int | None = None) -> DataFrame:
    """A row for each file, zeros where it has nothing: duplicates, avg_similarity, clusters, loc_reduction, strategies, total_sequences, candidates_analyzed.

    files: file; pairs: file1, file2, overall; clusters: cluster_id, file, loc_reduction, strategy (a row for each member file or more); sequences: file, and
    total_sequences where they are counted already. ``candidates`` is the project's number, which every file repeats.
    """
    each = pairs.select(F.explode(F.array_distinct(F.array("file1", "file2"))).alias("file"), "overall")
    out = files.select("file").distinct().join(each.groupBy("file").agg(F.count("*").alias("duplicates"), F.avg("overall").alias("avg_similarity")), "file", "left")
    if clusters is not None:
        own = clusters.select("cluster_id", "file", "loc_reduction", "strategy").distinct()
        out = out.join(own.groupBy("file").agg(F.count("*").alias("clusters"), F.sum("loc_reduction").alias("loc_reduction"), F.array_join(F.array_sort(F.collect_set("strategy")), ";").alias("strategies")), "file", "left")
        out = out.withColumn("strategies", F.coalesce("strategies", F.lit("NONE")))
    if sequences is not None:
        n = F.sum("total_sequences") if "total_sequences" in sequences.columns else F.count("*")
        out = out.join(sequences.groupBy("file").agg(n.alias("total_sequences")), "file", "left")
    if candidates is not None:
        out = out.withColumn("candidates_analyzed", F.lit(candidates).cast("long"))
    return out.na.fill(0).na.fill(0.0)


def project_metrics(report: DataFrame) -> DataFrame:
    """Sums over the rows of files, in which a pair over two files counts twice; candidates are the project's, once."""
    whole = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("duplicates", "clusters", "loc_reduction", "total_sequences") if c in report.columns]
    whole += [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("candidates_analyzed",) if c in report.columns]
    return report.agg(F.count("*").alias("total_files"), *whole, F.coalesce(F.sum(F.col("avg_similarity") * F.col("duplicates")) / F.nullif(F.sum("duplicates"), F.lit(0)), F.lit(0.0)).alias("avg_similarity"))


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The best n pairs of each file. pairs: file, id1, id2, overall."""
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("overall"), "id1", "id2"))
    return pairs.withColumn("place", place).where(F.col("place") <= n)


def json_report(report: DataFrame, project: str) -> DataFrame:
    """One JSON line for each file that has duplicates."""
    return report.where("duplicates > 0").select("file", F.to_json(F.struct(F.lit(project).alias("project"), *report.columns)).alias("json"))


def csv_lines(report: DataFrame) -> DataFrame:
    """A line for each file, scores with two digits; values with commas or quotes are quoted."""
    def field(c: str, kind: str) -> Column:
        if kind == "double":
            return F.format_string("%.2f", c)
        text = F.col(c).cast("string")
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return report.select("file", F.concat_ws(",", *[field(c, k) for c, k in report.dtypes]).alias("line"))


def write_metrics(report: DataFrame, path: str, kind: str) -> None:
    """kind: csv or json, in any case."""
    kind = kind.lower()
    if kind == "csv":
        report.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        report.write.mode("overwrite").json(path)
    else:
        raise ValueError("kind must be csv or json")


def text_report(report: DataFrame, project: str, files: int = 1000) -> str:
    """A summary and at most ``files`` lines, those with most duplicates; for people to read."""
    total = project_metrics(report).first()
    lines = [f"Project {project}: {total['total_files']} files, {total['duplicates']} duplicates, {total['avg_similarity']:.2f} similarity on average"]
    for r in report.where("duplicates > 0").orderBy(F.desc("duplicates"), "file").limit(files).collect():
        lines.append(f"{r['file']}: {r['duplicates']} duplicates, {r['avg_similarity']:.2f}")
    return "\n".join(lines)


def diff_stats(before: str, after: str) -> dict[str, int]:
    """Lines added, removed and the difference."""
    ops = difflib.SequenceMatcher(None, before.splitlines(), after.splitlines(), autojunk=False).get_opcodes()
    added = sum(j2 - j1 for tag, _, _, j1, j2 in ops if tag in ("insert", "replace"))
    removed = sum(i2 - i1 for tag, i1, i2, _, _ in ops if tag in ("delete", "replace"))
    return {"added": added, "removed": removed, "net": added - removed}


def unified_diff(before: str, after: str, name: str) -> str:
    return "\n".join(difflib.unified_diff(before.splitlines(), after.splitlines(), f"a/{name}", f"b/{name}", lineterm=""))


def side_by_side(before: str, after: str, width: int = 60) -> str:
    rows = []
    left, right = before.splitlines(), after.splitlines()
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        for k in range(max(i2 - i1, j2 - j1)):
            a, b = (x[s + k] if s + k < e else "" for x, s, e in ((left, i1, i2), (right, j1, j2)))
            rows.append(f"{a[:width]:<{width}} {' ' if tag == 'equal' else '|'} {b[:width]}".rstrip())
    return "\n".join(rows)


def outcomes(sessions: DataFrame) -> DataFrame:
    """Counts and lines by status. sessions: status, added, removed."""
    return sessions.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("added") - F.col("removed")).alias("net_lines"))
