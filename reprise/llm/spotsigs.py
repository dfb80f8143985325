"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Everything is column expressions. An anchor is a common word; its signature is the anchor with the next content words, common
words skipped. A text's fingerprint is its set of signatures, hashed to 32 bits. Sets are partitioned by the logarithm
of their length: sets from partitions that aren't neighbours have lengths too far apart to be alike, so they never meet.
fingerprint_edits compares given pairs, whose likeness is their Jaccard whatever their lengths; similar_sets finds all alike pairs of a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.storage import shuffle_partitions

# Common words of English, French, German and Spanish, the anchors.
ANCHORS = """
a an and are as at be but by for from had has have he in is it its of on or that the this to was were which with
au aux ce dans de des du elle en est et il la le les mais ne par pas pour que qui se sur un une
auf aus das dem den der die ein eine er es für im ist mit nicht sich sie und von war wie zu zur
al como con del el ha las lo los más no para por su sus una y
""".split()
#: What parts words: ASCII characters that are neither letters nor digits.
SEPARATOR = r"[\x00-/:-@\[-`{-\x7f]+"
CHAIN = 2
#: Least Jaccard of a near-duplicate; it sets how wide a partition of lengths is.
LEAST = 0.8
#: Documents that a bucket of neighbours holds on average, and buckets at most.
BUCKET, MOST_BUCKETS = 1000, 20_000
_MASK = (1 << 32) - 1


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add ``out``: the sorted distinct signatures of a text column without nulls. A text without any has one, of the whole text."""
    df = df.select("*", F.array_remove(F.split(F.lower(text), SEPARATOR, -1), "").alias("_w"))
    places = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: ~F.get("_w", i).isin(ANCHORS))
    df = df.select("*", F.when(F.size("_w") > 0, places).otherwise(F.array().cast("array<int>")).alias("_p"))

    def anchors_before(p: Column, k: Column) -> Column:
        """Signatures of the anchors between a content word and the one before it."""
        before = F.coalesce(F.get("_p", k - 1), F.lit(-1))
        words = [F.get("_w", p), *(F.get("_w", F.get("_p", k + n)) for n in range(1, chain))]
        made = F.transform(F.slice("_w", before + 2, p - before - 1), lambda a: F.xxhash64(a, *words).bitwiseAND(F.lit(_MASK)))
        return F.when((p - before > 1) & (k + chain <= F.size("_p")), made)

    found = F.flatten(F.filter(F.transform("_p", anchors_before), lambda x: x.isNotNull()))
    df = df.select("*", F.sort_array(F.array_distinct(found)).alias("_s"))
    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit(_MASK)))
    return df.select("*", F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole).alias(out)).drop("_w", "_p", "_s")


def length_partition(signatures: Column, least: float = LEAST) -> Column:
    """Sets whose Jaccard is at least ``least`` are in one partition or in neighbouring ones: their lengths differ by at most that factor."""
    return F.floor(F.log(F.size(signatures)) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def similar_sets(sets: DataFrame, key: str, signatures: str, least: float = 0.8) -> DataFrame:
    """(id1, id2, likeness): every pair of keys, id1 < id2, whose distinct signature sets have a Jaccard of at least ``least``.

    ``sets`` has one row for each distinct set (copies belong to one key). Sets are dealt by length partition, each to its own and to
    the one below, so a pair meets where the longer one's neighbours are. Within a partition they meet by their rarest signatures: of
    a set of n, the n - ceil(least * n) + 1 that are rarest over all sets, of which two alike sets share one. A pair is taken at the first one
    that both have, pruned by lengths, and verified in the join; nothing is dropped. Null or empty sets are alike to none.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = sets.select(F.col(key).alias("id"), F.col(signatures).alias("s")).where("id is not null and size(s) > 0")
    rows = rows.withColumn("partition", length_partition(F.col("s"), least) if least < 1 else F.size("s"))
    common = rows.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    ranked = rows.select("id", F.explode("s").alias("x")).join(common, "x").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("r"))
    kept = F.expr(f"size(r) - cast(ceil({least!r} * size(r) - 1e-9) as int) + 1")
    prefix = ranked.select("id", F.slice("r", F.lit(1), kept).alias("p"))
    whole = rows.join(prefix, "id")
    own = whole.select("id", "s", "p", "partition", F.explode("p").alias("at"))
    a = own.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("p").alias("pa"), F.explode(F.array("partition", F.col("partition") - 1)).alias("deal"), "at", F.col("partition").alias("ka"))
    b = own.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("p").alias("pb"), F.col("partition").alias("deal"), "at")
    met = a.join(b, ["deal", "at"]).where((F.col("ka") > F.col("deal")) | (F.col("a") < F.col("b"))).where(F.col("a") != F.col("b"))
    n, m = F.size("sa"), F.size("sb")
    met = met.where((F.least(n, m) >= F.lit(least) * F.greatest(n, m) - F.lit(1e-9)) & (F.array_min(F.array_intersect("pa", "pb")) == F.col("at")))
    found = met.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= F.lit(least - 1e-12))
    return found.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "likeness")


def as_text(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.hex(x))), " ")


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at most doc_id, by two short searches; nulls are in bucket 0."""
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>") for x in (bounds[::step], bounds))  # constants: folded once
    lower = F.greatest(F.lit(0), F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) - 1)
    inside = F.filter(F.slice(fine, lower * step + 1, F.lit(step)), lambda b: b <= F.col("doc_id"))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(lower * step + F.size(inside)) if bounds else F.lit(0)


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET) -> tuple[DataFrame, Window]:
    """(doc_id, text, stand_in, next_text): each document with the text of the next, by ascending doc_id, nulls first; after the last comes the first.

    Documents are dealt into buckets of neighbouring ids, by approximate quantiles. Each bucket ends with a stand-in, the first
    document of the next, so that no document looks beyond its bucket. Also returns the window, for further leads.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, max(4 * shuffle_partitions(spark), n // bucket_rows), n))
    cuts = [k / buckets for k in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * buckets)).alias("b")).first()["b"] if cuts else None
    rows = rows.withColumn("bucket", _bucket(sorted(set(found or []))))
    # one row a bucket: at most MOST_BUCKETS
    firsts = rows.groupBy("bucket").agg(F.when(F.bool_or(F.col("doc_id").isNull()), F.lit(None)).otherwise(F.min("doc_id")).alias("doc_id"))
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("doc_id", F.coalesce(F.lag("bucket").over(order), last).alias("bucket"))
    r, b = rows.drop("bucket").alias("r"), F.broadcast(before).alias("b")
    ends = r.join(b, F.col("r.doc_id").eqNullSafe(F.col("b.doc_id"))).groupBy("b.bucket", "r.doc_id").agg(F.min("text").alias("text"))
    both = rows.withColumn("stand_in", F.lit(False)).unionByName(ends.withColumn("stand_in", F.lit(True)))
    inside = Window.partitionBy("bucket").orderBy("stand_in", F.asc_nulls_first("doc_id"), "text")
    return both.select("bucket", "stand_in", "doc_id", "text", F.lead("text").over(inside).alias("next_text")), inside


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited text, whose last quarter is the beginning of the next document.

    Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text is an empty one. Rows of one id follow each other by text. A single document is its own next one; an
    empty table gives no rows.
    """
    rows, inside = neighbours(docs)
    n = F.length("text")
    quarter = F.expr("length(text) div 4").cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - quarter), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    rows = rows.select("bucket", "stand_in", "doc_id", "text", edited.alias("edited"))
    rows = with_signatures(with_signatures(rows, "text", "own"), "edited", "other")
    rows = rows.select("bucket", "stand_in", "doc_id", "text", "own", "other", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.lead("own").over(inside).alias("next"))
    return rows.where(~F.col("stand_in")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
