"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage, in column expressions.

A text's shingles are runs of five words (a shorter text is one shingle). Each shingle is hashed once; its high bits
name one of ``bins`` bins and each bin keeps its smallest hash. An empty bin takes the value of the first non-empty bin
in a pseudo-random order of its own that is the same for every text (a few probes, then the smallest of a hash over the
non-empty bins), so bins of two texts agree with probability equal to their Jaccard similarity. The low eight bits of
each bin are kept, two hex digits a bin; ``likeness`` takes chance agreement of eight bits out again.

Null and empty texts have the fingerprint of no shingles, all zeros; two of them are alike (1), one of them is unlike any
other (0). Equal texts have equal fingerprints. Extra columns are kept by ``fingerprints`` and not read by ``neighbours``;
names beginning ``_mh`` are the operator's own.
"""

from __future__ import annotations

import collections
import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common

WIDTH, LOG_BINS, PROBES = 5, 7, 12
BINS = 1 << LOG_BINS
_BLANKS = " \t\n\x0b\f\r"


#: The greatest hash of a bin stands for an empty one.
_NONE = (1 << (63 - LOG_BINS)) - 1


def _bin(value: Column) -> Column:
    return F.shiftright(value, 63 - LOG_BINS)


def _probes() -> list[int]:
    """The bins that each bin looks at when empty, ``PROBES`` a bin: Spark's xxhash64 of the bin and the probe's number."""
    four = lambda x: x.to_bytes(4, "little")
    return [xxhash.xxh64_intdigest(four(k), xxhash.xxh64_intdigest(four(b), 42)) % BINS for b in range(BINS) for k in range(PROBES)]


def signature(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with ``out``: the low byte of each bin, or null for a text without words."""
    words = F.split(F.btrim(F.col(text), F.lit(_BLANKS)), common.WORD_BREAK)
    docs = docs.withColumn("_mh_words", F.transform(words, lambda w: F.xxhash64(w)))
    blank = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANKS)) == ""
    h, n = F.col("_mh_words"), F.size("_mh_words")
    run = lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i, WIDTH)), 1)
    shingles = F.when(n >= WIDTH, F.transform(F.sequence(F.lit(1), n - WIDTH + 1), run)).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(h), 1)))
    ends = F.array(*[F.lit((b << (63 - LOG_BINS)) | _NONE).cast("long") for b in range(BINS)])
    docs = docs.withColumn("_mh_hashes", F.sort_array(F.when(~blank, F.concat(shingles, ends))))
    s = F.col("_mh_hashes")
    # In sorted order a bin's smallest hash is the first of its run; each bin has its greatest hash at least.
    first = F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))
    docs = docs.withColumn("_mh_bins", F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_NONE)) != _NONE, x))).drop("_mh_words", "_mh_hashes")
    bins, table = F.col("_mh_bins"), F.array(*[F.lit(p) for p in _probes()])
    docs = docs.withColumn("_mh_full", F.filter(bins, lambda x: x.isNotNull()))

    def filled(x: Column, b: Column) -> Column:
        probes = [F.get(bins, F.get(table, b * PROBES + k)) for k in range(PROBES)]
        ranked = F.array_min(F.transform("_mh_full", lambda y: F.struct(F.xxhash64(b, _bin(y).cast("int")).alias("rank"), y.alias("value"))))
        return F.coalesce(x, *probes, ranked["value"]).bitwiseAND(F.lit(255)).cast("short")

    return docs.withColumn(out, F.transform(bins, filled)).drop("_mh_full", "_mh_bins")


def packed(bits: Column) -> Column:
    """The signature as a string of two hex digits a bin."""
    digits = F.array_join(F.transform(bits, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")
    return F.coalesce(digits, F.lit("00" * BINS))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins without what chance adds, between 0 and 1."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(a, i) == F.get(b, i))) / F.lit(float(BINS))
    corrected = F.greatest(F.lit(0.0), (same - 1 / 256) / (1 - 1 / 256))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(corrected)


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``; a column of that name is replaced."""
    return signature(docs.drop("fingerprint"), text, "_mh").withColumn("fingerprint", packed(F.col("_mh"))).drop("_mh")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``_mh_next``: the given columns of the next row by descending doc_id.

    The first row follows the last; equal ids go by a hash of the text, then the text; null ids come last. The id range is
    cut at approximate quantiles, and an id that fills several ranges (or the null ids) by the text's hash. Each range is
    one window partition, and the first row of a range is also dealt to the range before it, so no task sees more than a
    range, but for rows that repeat both id and text. Only the cuts and each range's top reach the driver or a broadcast:
    a number of rows set by the shuffle partitions, whatever the input."""
    spark = docs.sparkSession
    ranges = 6 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    cuts, total, known = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges), F.count(F.lit(1)), F.count("id")).first()
    times = collections.Counter(cuts or [])
    cuts = sorted(times)
    shared = {v: n for v, n in times.items() if n > 1}  # ids that fill a range and more
    of_null = -(-(total - known) * ranges // max(total, 1))
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    deal = F.lit(1)
    if shared or of_null > 1:
        deal = F.when(F.col("doc_id").isNull(), F.lit(max(of_null, 1)))
        if shared:
            deal = deal.otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in shared.items() for x in pair]), F.col("doc_id").cast("long")), F.lit(1)))
        deal = F.coalesce(deal, F.lit(1)).cast("long")
        rank = F.when(deal > 1, hashed).otherwise(0)
        deal = F.shiftright(F.shiftright(rank, 32) * deal, 31)
    else:
        rank = deal = F.lit(0).cast("long")
    place = F.lit(0)
    if cuts:
        # Two short lists find the range: which block of cuts, then which of the block's.
        step = math.isqrt(len(cuts)) + 1
        longs = lambda values: F.array(*[F.lit(c) for c in values]).cast("array<long>")
        blocks = F.array(*[longs(cuts[i : i + step]) for i in range(0, len(cuts) + 1, step)])
        under = lambda a: F.size(F.filter(a, lambda c: c < F.col("doc_id")))
        block = under(longs(cuts[step - 1 :: step]))
        place = F.when(F.col("doc_id").isNull(), -1).otherwise(block * step + under(F.get(blocks, block)))
    docs = docs.withColumn("_mh_range", place.cast("long") * (ranges + 1) + deal).withColumn("_mh_rank", rank)
    tops = docs.groupBy("_mh_range").agg(F.max(F.struct(F.col("doc_id").cast("long").alias("id"), F.col("_mh_rank").alias("rank"))).alias("top")).collect()
    tops = sorted(((r["_mh_range"], r["top"]["id"], r["top"]["rank"]) for r in tops), reverse=True)
    dealt_to = [(at, top, rank, tops[i - 1][0]) for i, (at, top, rank) in enumerate(tops)]
    known = spark.createDataFrame(dealt_to, "_mh_range long, _mh_top long, _mh_most long, _mh_before long")
    docs = docs.join(F.broadcast(known), "_mh_range")
    first = F.col("doc_id").cast("long").eqNullSafe(F.col("_mh_top")) & (F.col("_mh_rank") == F.col("_mh_most"))
    spots = F.array(F.struct(F.col("_mh_range").alias("at"), F.lit(0).alias("copy")), F.when(first, F.struct(F.col("_mh_before").alias("at"), F.lit(1).alias("copy"))))
    dealt = docs.withColumn("_mh_spot", F.explode(F.filter(spots, lambda s: s.isNotNull())))
    order = Window.partitionBy("_mh_spot.at").orderBy("_mh_spot.copy", F.col("doc_id").desc_nulls_last(), hashed.desc(), F.col("text").desc_nulls_last())
    followed = dealt.withColumn("_mh_next", F.lead(F.struct(*columns)).over(order))
    return followed.where("_mh_spot.copy = 0").drop("_mh_spot", "_mh_range", "_mh_rank", "_mh_top", "_mh_most", "_mh_before")


def neighbours(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of the text with its second half replaced from the next document, and likenesses."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(signature(docs, "text", "_mh"), ["text", "_mh"])
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_mh_next.text", F.lit(1), half))
    docs = docs.select("doc_id", "n_chars", "_mh", F.col("_mh_next._mh").alias("_mh_after"), edited.alias("_mh_text"))
    docs = signature(docs.withColumn("edited_sha256", F.sha2(F.col("_mh_text"), 256)), "_mh_text", "_mh_edited").drop("_mh_text")
    mine = F.col("_mh")
    return docs.select("doc_id", "n_chars", "edited_sha256", packed(mine).alias("fingerprint"), packed(F.col("_mh_edited")).alias("edited_fingerprint"), likeness(mine, F.col("_mh_edited")).alias("near_edited"), likeness(mine, F.col("_mh_after")).alias("near_next"))
