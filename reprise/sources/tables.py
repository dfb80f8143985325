"""Adapters from tables and files to units: ordered pieces of text in containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.config import EXCLUDES

#: Ends of units in prose: marks with white space behind, or line ends.
UNIT_BREAK = r"[.!?]+[ \t\r\n]+|\n+"
# Fixed value: what an HTML page drops before its text is read.
_HTML = ((r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), (r"<[^>]*>", "\n"), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&amp;", "&"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose_units(df: DataFrame, container: str, text: str) -> DataFrame:
    """(container_id, unit_idx, text): units in order; blank ones are left out, a null text has none."""
    pieces = F.filter(F.split(text, UNIT_BREAK, -1), lambda x: F.regexp_replace(x, r"[ \t\r\n]", "") != "")
    return df.select(F.col(container).alias("container_id"), F.posexplode(pieces).alias("unit_idx", "text"))


def unit_arrays(df: DataFrame, container: str, text: str) -> DataFrame:
    """(container_id, units): as prose_units, one row a container; no shuffle."""
    pieces = F.filter(F.split(text, UNIT_BREAK, -1), lambda x: F.regexp_replace(x, r"[ \t\r\n]", "") != "")
    return df.select(F.col(container).alias("container_id"), F.coalesce(pieces, F.array().cast("array<string>")).alias("units"))


def page_text(html: Column) -> Column:
    for pattern, to in _HTML:
        html = F.regexp_replace(html, pattern, to)
    return html


def page_units(pages: DataFrame) -> DataFrame:
    return prose_units(pages.select("page_id", page_text(F.col("html")).alias("text")), "page_id", "text")


def conversation_units(turns: DataFrame) -> DataFrame:
    """A turn is a unit; turns are in order within their conversation."""
    rows = turns.where(F.col("text").isNotNull())
    return rows.select(F.col("conv_id").alias("container_id"), F.col("turn").cast("int").alias("unit_idx"), "text")


def read_sources(spark: SparkSession, base_path: str, glob: str = "*.java", exclude: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """(file, text) of all source files below a path that no exclude glob meets; each file once."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(base_path)
    rows = found.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.where(~excluded(F.col("file"), exclude)).where("file is not null").dropDuplicates(["file"])


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` don't; a leading ``**/`` may stand for no folder."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".^$+{}[]()|\\" else glob[i]), i + 1
    return f"^{out}$"


def excluded(path: Column, globs: tuple[str, ...] = EXCLUDES) -> Column:
    met = F.lit(False)
    for g in globs:
        met = met | path.rlike(glob_to_regex(g))
    return F.coalesce(met, F.lit(False))


def targeted(name: Column, targets: str | None) -> Column:
    """Names in a comma list, and what is nested in them (behind ``.`` or ``$``). Without targets, all."""
    wanted = [t.strip() for t in (targets or "").split(",") if t.strip()]
    if not wanted:
        return F.lit(True)
    met = name.isin(wanted)
    for t in wanted:
        met = met | name.startswith(f"{t}.") | name.startswith(f"{t}$")
    return met


def save_session(clusters: DataFrame, path: str) -> None:
    clusters.write.mode("overwrite").json(path)


def load_session(spark: SparkSession, path: str, schema) -> DataFrame:
    """The clusters of a saved session, with the types they had."""
    return spark.read.schema(schema).json(path)
