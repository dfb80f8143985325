"""Secret scans: three fixed patterns, and character Markov models for what they miss.

Everything is column expressions. Positions come from cutting a text at a pattern's matches: a match starts where the pieces
and matches before it end. Two first-order models, of random strings and of ordinary identifiers, give each long run
of key characters a log-likelihood ratio; runs with a letter, above a threshold, that no fixed span touches are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The patterns of the contract and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs that are shorter don't count, and a run of 24 or more is taken whole
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{5,}"
#: Log-likelihood ratio from which a run counts as random, in all and per character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.6
SPAN = "array<struct<start:int,end:int,kind:int>>"
_BLOCK = 256


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _located(df: DataFrame, pattern: str, least: Column | None, group: int, kind: int, out: str, wanted=None) -> DataFrame:
    """Add ``out``: spans of the pattern's matches in ``text``. wanted: which matches to keep, by the match's text.

    Sums over earlier pieces go by blocks, so many matches in one long text stay cheap.
    """
    df = df.select("*", F.when(least, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("_m"))
    if group:
        df = df.select("*", F.when(F.size("_m") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("_v"))
    else:
        df = df.select("*", F.col("_m").alias("_v"))
    df = df.select("*", F.when(F.size("_m") > 0, F.transform("_v", wanted)).alias("_w")).select("*", F.exists("_w", lambda x: x).alias("_any"))
    df = df.select("*", F.when(F.col("_any"), F.transform(F.split("text", pattern, -1), lambda x: F.length(x))).alias("_g"))
    df = df.select("*", F.when(F.col("_any"), F.transform("_m", lambda m, i: F.length(m) + F.get("_g", i))).alias("_l"))
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_m) - 1) div {_BLOCK}").cast("int")), lambda b: _sum(F.slice("_l", b * _BLOCK + 1, F.lit(_BLOCK))))
    df = df.select("*", F.when(F.col("_any"), blocks).alias("_b"))
    df = df.select("*", F.when(F.col("_any"), F.transform("_b", lambda x, i: _sum(F.slice("_b", F.lit(1), i)))).alias("_s"))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get("_s", block) + _sum(F.slice("_l", block * _BLOCK + 1, i % _BLOCK)) + F.get("_g", i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"))

    indexed = F.transform("_m", lambda m, i: F.when(F.get("_w", i), span(m, i)))
    found = F.when(F.col("_any"), F.filter(indexed, lambda x: x.isNotNull()))
    return df.select("*", F.coalesce(found, F.array().cast(SPAN)).alias(out)).drop("_m", "_v", "_w", "_any", "_g", "_l", "_b", "_s")


def base_spans(df: DataFrame) -> DataFrame:
    """Add assign, access and hex: the spans of the fixed patterns in ``text``, which must not be null."""
    df = _located(df, ASSIGN, F.col("text").rlike(r"(?i)passw|secret|token|api_?key"), 1, 0, "assign", lambda v: F.length(v) >= ASSIGN_LEAST)
    df = _located(df, ACCESS, F.col("text").contains("AKIA"), 0, 1, "access", lambda v: F.length(v) >= ACCESS_LEAST)
    return _located(df, HEX, F.col("text").rlike(HEX), 0, 2, "hex", lambda v: F.lit(True))


def labelled_samples(docs: DataFrame, made: int = 3000) -> DataFrame:
    """(value, n, random): what the models learn from.

    Random: digests in hexadecimal and base 64, of ``made`` numbers each. Ordinary: the identifiers of all documents with how often
    they occur, between underscores, so that joined names are ordinary too; texts with the fixed patterns' spans are left out.
    """
    clean = docs.where(F.col("text").isNotNull() & ~F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    names = clean.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    ordinary = names.select(F.concat(F.lit("_"), "name", F.lit("_")).alias("value"), "n", F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    forms = F.array(digest, base64, F.upper(F.substring(digest, 1, 24)), F.regexp_replace(base64, "[+/]", ""))
    random = docs.sparkSession.range(made).select(F.explode(forms).alias("value"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("random"))
    return ordinary.unionByName(random)


def train(samples: DataFrame, even: float = 0.002) -> list[float]:
    """The table of log ratios by pair of ASCII characters (128 * first + second); at most 16,384 counts a class come to the driver.

    ``even`` is the share of each model that all characters have alike, so a pair never seen weighs the same however large the sample is.
    """
    shown = samples.where(F.length("value") >= 2).select("random", "n", F.split("value", "").alias("c"))
    codes = shown.select("random", "n", F.transform("c", lambda x: F.ascii(x)).alias("c"))
    pairs = codes.select("random", "n", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda x, y: x * 128 + y)).alias("pair"))
    rows = pairs.where("pair between 0 and 16383").groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    counts = {False: {}, True: {}}
    for r in rows:
        counts[r["random"]][r["pair"]] = r["n"]
    table = [0.0] * 16384
    for a in alphabet:
        total = {k: sum(v.get(128 * a + b, 0) for b in alphabet) for k, v in counts.items()}
        for b in alphabet:
            p = {k: (1 - even) * v.get(128 * a + b, 0) / total[k] + even / len(alphabet) if total[k] else 1 / len(alphabet) for k, v in counts.items()}
            table[128 * a + b] = round(math.log(p[True] / p[False]), 4)
    return table


def add_markov(df: DataFrame, table: list[float]) -> DataFrame:
    """Add markov: runs of key characters that the models call random and that no fixed span touches."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # a constant: folded once

    def random(v: Column) -> Column:
        """One walk along the characters, which are split once; the state is the character before and the sum so far."""
        def step(a: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.struct(code.alias("last"), (a["sum"] + F.coalesce(F.get(ratios, a["last"] * 128 + code), F.lit(0.0))).alias("sum"))

        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
        total = F.aggregate(F.split(v, ""), start, step, lambda a: a["sum"])
        return v.rlike("[A-Za-z]") & (total >= F.greatest(F.lit(LEAST_RATIO), F.length(v) * F.lit(LEAST_MEAN)))

    df = _located(df, RUN, F.col("text").rlike(RUN), 0, 3, "_runs", lambda v: random(v))
    # fixed spans in blocks of neighbours, so that a run looks into those blocks alone that it can touch
    ordered = F.when(F.size("_runs") > 0, F.array_sort(F.concat("assign", "access", "hex"))).otherwise(F.array().cast(SPAN))
    df = df.select("*", ordered.alias("_f"))
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_f) - 1) div {_BLOCK}").cast("int")), lambda b: F.slice("_f", b * _BLOCK + 1, F.lit(_BLOCK)))
    df = df.select("*", F.when(F.size("_f") > 0, blocks).otherwise(F.array().cast(f"array<{SPAN}>")).alias("_b"))
    ranges = F.transform("_b", lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda x: x["end"])).alias("high"), b.alias("own")))
    df = df.select("*", ranges.alias("_r"))
    free = F.filter("_runs", lambda r: ~F.exists("_r", lambda b: (b["low"] < r["end"]) & (r["start"] < b["high"]) & F.exists(b["own"], lambda x: (x["start"] < r["end"]) & (r["start"] < x["end"]))))
    return df.select("*", F.when(F.size("_r") > 0, free).otherwise(F.col("_runs")).alias("markov")).drop("_runs", "_f", "_b", "_r")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) under ``doc``, and per row n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` holds the spans as (start, end, kind) in code points, in no set order. A null text is an empty one and has none;
    repeated rows and null ids are scanned row by row; an empty table gives no rows.
    """
    table = train(labelled_samples(docs)) if table is None else table
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = add_markov(base_spans(rows), table)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.concat("assign", "access", "hex")
    rows = rows.select("doc", "text", *counts, base.alias("base"), F.concat(base, "markov").alias("found"))
    return rows.select("doc", "text", *[f"n_{k}" for k in KINDS[:3]], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "found")


def with_redacted(found: DataFrame, out: str, mark: str = "[SECRET]") -> DataFrame:
    """find_secrets' rows and ``out``: the text with every span, or run of spans that overlap, replaced by ``mark``.

    The text is split into characters once, and its pieces are joined once.
    """
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    rows = found.select("*", F.when(F.size("found") > 0, ordered).alias("_o"))
    seen = F.aggregate("_o", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1), s["end"]))))
    # per span: where all spans before it end
    rows = rows.select("*", F.when(F.size("_o") > 0, seen).alias("_e"), F.when(F.size("_o") > 0, F.split("text", "")).alias("_c"))

    def piece(s: Column, i: Column) -> Column:
        gap = F.array_join(F.slice("_c", F.get("_e", i) + 1, F.greatest(F.lit(0), s["start"] - F.get("_e", i))), "")
        return F.when(s["start"] >= F.get("_e", i), F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

    last = F.element_at("_e", -1)
    tail = F.array_join(F.slice("_c", last + 1, F.greatest(F.lit(0), F.size("_c") - last)), "")
    whole = F.concat(F.array_join(F.transform("_o", piece), ""), tail)
    return rows.select("*", F.when(F.size("_o") > 0, whole).otherwise(F.col("text")).alias(out)).drop("_o", "_e", "_c")
