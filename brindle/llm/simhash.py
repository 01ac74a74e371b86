"""SimHash near-duplicates: fingerprints of word shingles, joined on pigeonhole blocks and checked bit by bit.

A text's A-Z are lower-cased; its shingles are runs of ``width`` words joined by spaces, repeats included (a shorter
text is one shingle, a text without words has fingerprint zero). Bit ``i`` is set if it is set in over half of the
shingles' XXH64 values (seed 42).

Equal fingerprints are one node from the start, so copies cost one row. With ``radius`` r the 64 bits are cut into
``r + agree`` blocks: two fingerprints within the radius agree on at least ``agree`` of them, so every link shares the
key of some ``agree`` blocks. Any ``agree`` gives the same links; the default is the least whose keys have as many values
as there are fingerprints, so that a key's company does not grow with the corpus. A key with few fingerprints is joined
with itself; one with many is dealt into slices that are compared pair by pair of slices in numpy, each task handing on
only the links of a spanning forest, so no group is ever whole in one task and its pairs are never rows. The links of
fingerprints are exact.

``representatives`` links texts whose sets of ``width`` words have Jaccard similarity ``similarity`` or more. Fingerprints
come first: pairs within ``radius`` bits, found by the same blocks and checked bit by bit, are links if the similarity
holds. No small radius reaches all such pairs, so what this leaves unsettled is looked for among the pairs that
share one of ``bands`` hashes, each of ``rows`` minima of the set under independent hash functions. A pair of similarity s
shares none with probability ``(1 - s ** rows) ** bands``, whatever the edit, which at 0.8 and the defaults is 1.3e-7.
All candidates are verified by the exact similarity, by keys in both passes: first each text is compared with the least of
its key; pairs of one component are then settled, all others are compared: as rows where the key is small, and otherwise
by slices whose tasks hold the sets themselves and hand on only verified links.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a component. A null doc_id never
names a component unless the component has no other. Other columns are not read. Texts are told apart by XXH64.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common
from brindle.llm.components import components
from brindle.llm.contamination import shingle_hashes, word_hashes

#: Fingerprints of one key up to which the key is joined with itself, and in one slice of a larger key.
SMALL, SLICE = 24, 1024
_APART, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprint(text: bytes, width: int) -> int:
    """The contract's fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    digest, whole = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= width:
        hashes = digest(whole, 42)
    else:
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends)]
        hashes = b"".join([digest(whole[a:b], 42) for a, b in zip(starts, ends[width - 1 :])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint``, a long with the 64 bits; a column of that name is replaced."""
    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text"):
            texts = part.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield part.append_column("fingerprint", pa.array(found))

    return docs.mapInArrow(run, common.extended(docs.schema, fingerprint="long"))


def enough_blocks(count: int, radius: int) -> int:
    """The least number of blocks in a key, two at least, that gives keys as many values as there are fingerprints."""
    agree = 2
    while agree < 8 and 64 * agree / (radius + agree) < math.log2(max(count, 2)):
        agree += 1
    return agree


def block_keys(value: Column, radius: int, agree: int) -> Column:
    """For each choice of blocks: the choice's number, the blocks' bits, and the value itself."""
    cuts = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(radius + agree), agree)):
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).alias("choice"), value.bitwiseAND(F.lit(signed)).alias("bits"), value.alias("value")))
    return F.array(*keys)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed(choice, bits, ...)`` whose key is not theirs alone, with the key's ``size``."""
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return common.shared_checkpoint(keyed.join(sizes, ["choice", "bits"]))


def small_pairs(keyed: DataFrame, node: str, radius: int) -> DataFrame:
    """Pairs ``(a, b)`` within the radius that share a key of at most ``SMALL`` rows."""
    small = keyed.where(F.col("size") <= SMALL)
    side = lambda x: small.select("choice", "bits", F.col(node).alias(x), F.col("value").alias(f"{x}_value"))
    near = F.bit_count(F.col("a_value").bitwiseXOR(F.col("b_value"))) <= radius
    return side("a").join(side("b"), ["choice", "bits"]).where((F.col("a") < F.col("b")) & near).select("a", "b")


def slice_pairs(keyed: DataFrame, node: str, rows: int) -> DataFrame:
    """Keys of over ``SMALL`` rows, dealt by ``node`` into slices of about ``rows``; a row for each pair of slices that it is in."""
    slices = F.ceil(F.col("size") / rows).cast("long")
    large = keyed.where(F.col("size") > SMALL).withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64(node), F.col("slices")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("other")
    return large.select("*", other).withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other"))


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of what is within the radius, between two arrays of fingerprints."""
    parent = {int(x): int(x) for x in np.r_[a, b]}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in a:
        for y in b[np.bitwise_count((b ^ x).view(np.uint64)) <= radius]:
            p, q = root(int(x)), root(int(y))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(x), int(y)))
    return np.array(out, np.int64).reshape(-1, 2)


def links(values: DataFrame, *, radius: int = 3, agree: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that give the components of ``values(fingerprint)`` (distinct) under Hamming distance ``radius``."""
    agree = agree or enough_blocks(values.count(), radius)
    key = F.explode(block_keys(F.col("fingerprint"), radius, agree)).alias("key")
    keyed = shared_keys(values.select(key).select("key.*"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        first = part["slice"].to_numpy() == part["low"].to_numpy()
        values = part["value"].to_numpy()
        a = values[first]
        b = a if part["low"].iloc[0] == part["high"].iloc[0] else values[~first]
        return pd.DataFrame(forest(a, b, radius), columns=["a", "b"])

    large = slice_pairs(keyed, "value", SLICE)
    return small_pairs(keyed, "value", radius).unionByName(large.groupBy("choice", "bits", "low", "high").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = 3, agree: int | None = None) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row: the smallest doc_id within reach of links.

    Rows meet in partial aggregates by fingerprint only; components are shuffled as one row per fingerprint."""
    marked = common.written(fingerprints(docs.select("doc_id", "text"), width=width).select("doc_id", "fingerprint"))
    nodes = common.written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fingerprint"), radius=radius, agree=agree)).withColumnRenamed("node", "fingerprint")
    nodes = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = nodes.join(named, "root").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The least value of each set under each of ``count`` hash functions, one row a set; an empty set has the greatest value."""
    out = np.full((len(sets), count), ~np.uint64(0))
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    begin = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    salts = common.mix(np.arange(1, count + 1, dtype=np.uint64) * _APART)
    for k, salt in enumerate(salts):
        x = (flat ^ salt) * _APART
        x ^= x >> np.uint64(32)
        x *= _ODD
        out[full, k] = np.minimum.reduceat(x, begin)
    return out


def marks(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, node, length, keys)`` of every row; ``node`` is xxhash64 of the text, null being empty, ``length`` its set's, ``keys`` a hash of each band."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text"):
            sets = word_sets(part.column("text"), width)
            least = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
            keys = np.zeros((len(sets), bands), np.uint64)
            for k in range(rows):
                keys = common.mix(keys * _APART + least[:, :, k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), sizes, lists], ["doc_id", "node", "length", "keys"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, length long, keys array<long>")


def word_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct runs of ``width`` words; a shorter text is one run, one without words has none."""
    words, cut = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], max(1, min(width, b - a)))) for a, b in zip(cut, cut[1:])]


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``(node, set)`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text"):
            sets = word_sets(part.column("text"), width)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("node"), lists], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose ``sets(node, set)`` are as similar as asked."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    whole = F.size("a_set") + F.size("b_set") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").where(both >= similarity * whole).select("a", "b")


def similar_forest(nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, similarity: float, prints: np.ndarray | None = None, radius: int = 0) -> np.ndarray:
    """Links that join the ``groups`` of texts at ``first`` and ``second`` wherever two of their sets are as similar as asked.

    With ``prints`` only pairs whose fingerprints are within ``radius`` are compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    known, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    group, held, out = np.unique(groups, return_inverse=True)[1], np.zeros(len(known), bool), []
    for x in first:
        other = second[(group[second] != group[x]) & (np.minimum(sizes[second], sizes[x]) >= similarity * np.maximum(sizes[second], sizes[x]))]
        if prints is not None:
            other = other[np.bitwise_count((prints[other] ^ prints[x]).view(np.uint64)) <= radius]
        if not len(other):
            continue
        mine = shingle[ends[x] - sizes[x] : ends[x]]
        held[mine] = True
        upto = np.r_[0, np.cumsum(held[shingle])]
        held[mine] = False
        both = upto[ends[other]] - upto[ends[other] - sizes[other]]
        for y in other[both >= similarity * (sizes[other] + sizes[x] - both)]:
            if group[x] != group[y]:
                group[group == group[y]] = group[x]
                out.append((nodes[x], nodes[y]))
    return np.array(out, np.int64).reshape(-1, 2)


def verified_links(keyed: DataFrame, sets: DataFrame, known: DataFrame | None, *, similarity: float, radius: int | None = None) -> DataFrame:
    """``known`` and the links that join all similar texts that share a key of ``keyed(choice, bits, size, node, length)``.

    With ``radius`` the rows have a fingerprint, ``value``, and only texts within that many bits are compared."""
    of = ["length"] if radius is None else ["length", "value"]

    def close(a: str, b: str) -> Column:
        lengths = F.least(f"{a}length", f"{b}length") >= similarity * F.greatest(f"{a}length", f"{b}length")
        return lengths if radius is None else lengths & (F.bit_count(F.col(f"{a}value").bitwiseXOR(F.col(f"{b}value"))) <= radius)

    least = keyed.groupBy("choice", "bits").agg(F.min(F.struct("node", *of)).alias("least"))
    stars = keyed.join(least, ["choice", "bits"]).where((F.col("node") > F.col("least.node")) & close("", "least."))
    stars = stars.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
    if known is not None:
        stars = stars.join(known, ["a", "b"], "left_anti")
    found = common.written(alike(stars, sets, similarity))
    if known is not None:
        found = known.unionByName(found)

    rest = keyed.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = rest.groupBy("choice", "bits").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("length").alias("volume")).where("low < high").drop("low", "high")
    rest = common.shared_checkpoint(rest.join(open_keys, ["choice", "bits"]))
    small = rest.where(F.col("size") <= SMALL)
    side = lambda x: small.select("choice", "bits", F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ["root", *of]])
    apart = (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & close("a_", "b_")
    pairs = side("a").join(side("b"), ["choice", "bits"]).where(apart).select("a", "b").distinct()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        place, one = np.arange(len(part)), part["low"].iloc[0] == part["high"].iloc[0]
        low = (part["slice"] == part["low"]).to_numpy()
        first, second = place[low], place if one else place[~low]
        within = () if radius is None else (part["value"].to_numpy(), radius)
        got = similar_forest(part["node"].to_numpy(), part["root"].to_numpy(), list(part["set"]), first, second, similarity, *within)
        return pd.DataFrame(got, columns=["a", "b"])

    # Slices follow the rows of a key, or its shingles where the texts are long.
    large = rest.where(F.col("size") > SMALL).withColumn("size", F.greatest("size", F.ceil(F.col("volume") / 512)))
    large = slice_pairs(large.select("choice", "bits", "node", "root", "size", *of[1:]), "node", SLICE).join(sets, "node")
    compared = large.groupBy("choice", "bits", "low", "high").applyInPandas(compare, "a long, b long")
    return found.unionByName(alike(pairs, sets, similarity)).unionByName(compared)


def similar_links(docs: DataFrame, values: DataFrame, *, width: int, similarity: float, radius: int) -> DataFrame:
    """Links ``(a, b)``, all verified, that give the components of ``values(node, length, keys)`` (nodes distinct)."""
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    prints = fingerprints(texts).groupBy("node").agg(F.first("fingerprint").alias("fingerprint"))
    block = F.explode(block_keys(F.col("fingerprint"), radius, enough_blocks(values.count(), radius))).alias("key")
    near = shared_keys(values.select("node", "length").join(prints, "node").select("node", "length", block).select("node", "length", "key.*"))
    keyed = shared_keys(values.select("node", "length", F.posexplode("keys").alias("choice", "bits")))
    # Copies meet in partial aggregates before they are dealt by node.
    compared = near.select("node").unionByName(keyed.select("node")).distinct()
    sets = common.written(shingle_sets(texts.dropDuplicates(["node"]).join(compared, "node", "left_semi"), width))
    found = common.written(verified_links(near, sets, None, similarity=similarity, radius=radius))
    return verified_links(keyed, sets, found, similarity=similarity)


def representatives(docs: DataFrame, *, width: int = 5, similarity: float = 0.8, radius: int = 3, bands: int = 40, rows: int = 5) -> DataFrame:
    """The row with the smallest doc_id of each group of similar texts, other columns kept; of equal rows one stays."""
    lowest = F.lit(-(1 << 63)).cast("long")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", lowest).alias("_sh_id"), F.col("node").alias("_sh_text"))
    nodes = marks(docs, width, bands, rows).groupBy("node").agg(F.min(place).alias("first"), F.first("length").alias("length"), F.first("keys").alias("keys"))
    nodes = common.written(nodes)
    roots = components(similar_links(docs, nodes.select("node", "length", "keys"), width=width, similarity=similarity, radius=radius))
    grouped = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = grouped.select("first._sh_id", "first._sh_text")
    keyed = docs.withColumn("_sh_id", F.coalesce("doc_id", lowest)).withColumn("_sh_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(kept, ["_sh_id", "_sh_text"]).dropDuplicates(["_sh_id", "_sh_text"]).select(*docs.columns)
