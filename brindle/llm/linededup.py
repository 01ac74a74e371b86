"""Line dedup by winnowing: minima of line windows are the fingerprints by which repeats are found, joined and deleted.

Lines are compared by a 64-bit hash of their trimmed text; lines without words are passed over. Windows are the least
runs of lines with ``min_words`` words from each line onward, and from each line back, and each two neighbours that are
both that long. The least line hash in a window is its fingerprint. It depends on the window alone, so all copies of a
window select the same one, and a window whose fingerprint is selected at one place only has no copy and is passed over.
Windows share minima, so there are fewer fingerprints than lines. What is left is joined by whole windows: each that
stands at a later place, by (doc_id, text, line), than the first of its kind is a match. Matches that share or touch
lines grow into one run both ways, and the runs are deleted.

A repeated run of ``min_words`` words is covered by the windows inside it: a line has its window onward or its window back
inside the run, or lies in the window from the run's first line; two neighbours share such a window, or are one. Each of
these is whole in the run's earlier copy, so each is a match, wherever else a part of the run may stand.

The earliest copy of every run stays. Null and empty texts have no lines and stay as they are; an empty table gives an
empty one. Rows that repeat both doc_id and text are one document and share its deletions; a null doc_id counts as the
smallest. Other columns are kept (those that begin ``_ld`` are the operator's own), ``n_chars`` excepted if present,
which follows the new text; a column with the name of the result's own is replaced. Expressions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common

_BLANKS = " \t\x0b\f\r"
_DOC = ["_ld_id", "_ld_text"]


def _keyed(docs: DataFrame) -> DataFrame:
    """With the document's key: its id, and a hash of its text for ids that repeat."""
    lowest = F.lit(-(1 << 63)).cast("long")
    return docs.withColumn("_ld_id", F.coalesce(F.col("doc_id").cast("long"), lowest)).withColumn("_ld_text", F.xxhash64("text"))


def lines(docs: DataFrame) -> DataFrame:
    """One row per line with words: its number, hash, words, rank among such lines and words before it."""
    found = _keyed(docs.select("doc_id", "text")).select(*_DOC, F.posexplode(F.split("text", "\n")).alias("line", "words"))
    found = found.withColumn("words", F.btrim("words", F.lit(_BLANKS))).where("words != ''")
    found = found.select(*_DOC, "line", F.xxhash64("words").alias("hash"), F.size(F.split("words", common.WORD_BREAK)).cast("long").alias("words"))
    found = found.repartition(*_DOC).dropDuplicates([*_DOC, "line"])
    order = Window.partitionBy(*_DOC).orderBy("line")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("before", before)


def windows(found: DataFrame, min_words: int) -> DataFrame:
    """The windows of each document: hash of all lines, fingerprint and its rank, first and last line."""
    ends = found.withColumn("end", F.col("before") + F.col("words"))
    document = Window.partitionBy(*_DOC)
    ahead = document.orderBy("before").rangeBetween(0, min_words - 1)
    back = document.orderBy("end").rangeBetween(1 - min_words, 0)
    pair = document.orderBy("before").rowsBetween(0, 1)

    def window(over, enough):
        low = F.min(F.struct("hash", "rank")).over(over)
        lines_ = F.first("line").over(over).alias("first_line"), F.last("line").over(over).alias("last_line")
        return F.when(enough, F.struct(F.xxhash64(F.collect_list("hash").over(over)).alias("gram"), low["hash"].alias("low"), low["rank"].alias("low_rank"), *lines_))

    long_enough = [F.sum("words").over(ahead) >= min_words, F.sum("words").over(back) >= min_words, (F.min("words").over(pair) >= min_words) & (F.count("words").over(pair) == 2)]
    each = ends.select(*_DOC, F.array(*[window(o, e) for o, e in zip((ahead, back, pair), long_enough)]).alias("windows"))
    each = each.select(*_DOC, F.explode(F.array_distinct(F.array_compact("windows"))).alias("window"))
    return each.select(*_DOC, "window.*")


def fingerprints(marks: DataFrame) -> DataFrame:
    """The places of all documents that some window selects, without repeats."""
    return marks.select(*_DOC, "low", "low_rank").distinct()


def repeated_runs(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """Runs to delete, ``(_ld_id, _ld_text, first_line, last_line)``, of the later copies; no two touch."""
    marks = common.shared_checkpoint(windows(lines(docs), min_words))
    place = F.struct(*_DOC, "low_rank")
    recurring = marks.groupBy("low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("low")
    kept = marks.join(recurring, "low", "left_semi")
    place = F.struct(*_DOC, "first_line")
    first = kept.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    matched = kept.join(first, "gram").where(place > F.col("first")).select(*_DOC, "first_line", "last_line")
    order = Window.partitionBy(*_DOC).orderBy("first_line", "last_line")
    reached = F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = matched.withColumn("opens", F.coalesce(F.col("first_line") > reached + 1, F.lit(True)).cast("long"))
    runs = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*_DOC, "run").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def _without(text: Column, cuts: Column) -> Column:
    """``text`` without the lines of sorted, disjoint cuts: the slices between them, in one walk over both lists."""

    def between(found: Column) -> Column:
        def piece(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.try_element_at(cuts, i)["last_line"] + 1)
            end = F.when(i == F.size(cuts), F.size(found)).otherwise(F.try_element_at(cuts, i + 1)["first_line"])
            return F.slice(found, start + 1, end - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), piece))

    # The array of one makes the split text a variable, so that it is not split again for every piece.
    return F.array_join(F.transform(F.array(F.split(text, "\n")), between)[0], "\n")


def dedup_lines(docs: DataFrame, *, min_words: int = 50, name: str = "removed") -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text`` and the cut lines (first, last) listed in a column of that name."""
    runs = repeated_runs(docs, min_words=min_words)
    cuts = runs.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("_ld_cuts"))
    # Only documents with cuts are split again.
    joined = _keyed(docs.drop(name)).join(cuts, _DOC, "left")
    removed = F.coalesce("_ld_cuts", F.array().cast("array<struct<first_line:int,last_line:int>>"))
    out = joined.withColumn("text", F.when(F.col("_ld_cuts").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_ld_cuts")))).withColumn(name, removed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_ld_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.drop(*_DOC, "_ld_cuts").select(*[c for c in docs.columns if c != name], name)
