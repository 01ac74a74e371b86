"""Sharding: records are dealt to weighted shards by rendezvous hashing of a stable key, and numbered within each shard.

Every shard draws a number in (0, 1) from the hash of (key, shard) and bids ``-weight / ln(number)``; the highest bid wins,
the lower shard on ties. So a shard wins in proportion to its weight, a new shard takes records only for itself, a shard
that leaves gives up only its own, and a changed weight moves records only into or out of that shard. Nothing but the key,
the shard's number and its weight is looked at.

Slots number a shard's rows from 0 in order of the key, gaps first, then of the other columns' hash. Rows are sorted by range
over (shard, key, hash, a salt from their place in the input) and written once; a row's slot is then its place in its
range plus the rows of its shard in earlier ranges, so no shard and no key, however hot, is numbered by one task. Expressions
only: no Python runs on the executors.

A null key is a key like any other. Equal keys share a shard; rows equal in all columns take neighbouring slots. Texts may be
null, empty or of any length: they are only carried. Columns that are named as the results are replaced; those
that begin ``_sh`` are the operator's own. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import common


def _bids(key: Column, weights: Sequence[float], first: int) -> Column:
    """The best bid among the shards ``first``, ``first + 1``, ...: a struct of the bid and the shard's negative number."""
    shards = F.array(*[F.struct(F.lit(i).cast("long").alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights, first)])
    drawn = lambda shard: (F.shiftrightunsigned(F.xxhash64(key, shard), 12) + 0.5) / F.lit(float(1 << 52))
    bid = lambda s: F.struct((-s["weight"] / F.ln(drawn(s["shard"]))).alias("bid"), (-s["shard"]).alias("shard"))
    return F.array_max(F.transform(shards, bid))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key`` among as many shards as there are weights. A weight of 0 wins nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("Give every shard a weight of 0 or more, and one of them more than 0.")
    return (-_bids(key, weights, 0)["shard"]).cast("int")


def grown_shard_of(key: Column, weights: Sequence[float], added: Sequence[float]) -> Column:
    """The shard of ``key`` when shards with the weights ``added`` join those of ``weights``."""
    shard_of(key, [*weights, *added])
    return (-F.greatest(_bids(key, weights, 0), _bids(key, added, len(weights)))["shard"]).cast("int")


def deal(rows: DataFrame, weights: Sequence[float], *, key: str = "doc_id", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with the shard of each and its place in that shard, as a table in the shared folder."""
    kept = [c for c in rows.columns if c not in (shard, slot)]
    plain = F.xxhash64(*[F.col(f"`{c}`").cast("string") if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in kept])
    marked = rows.select(*[F.col(f"`{c}`") for c in kept], shard_of(F.col(f"`{key}`"), weights).alias("_sh_shard"), plain.alias("_sh_tie"), F.monotonically_increasing_id().alias("_sh_salt"))
    order = ["_sh_shard", f"`{key}`", "_sh_tie", "_sh_salt"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("_sh_tie", "_sh_salt")
    # The number of a row within its range, which Spark counts up from the range's number times 2**33.
    placed = common.written(ranged.withColumn("_sh_at", F.monotonically_increasing_id()))
    block = F.shiftright("_sh_at", 33)
    runs = placed.groupBy("_sh_shard", block.alias("_sh_block")).agg(F.min("_sh_at").alias("_sh_from"), F.count(F.lit(1)).alias("_sh_rows"))
    before = Window.partitionBy("_sh_shard").orderBy("_sh_block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_sh_shard", "_sh_block", (F.coalesce(F.sum("_sh_rows").over(before), F.lit(0)) - F.col("_sh_from")).alias("_sh_shift"))
    # Ranges follow one another, so (shard, range) pairs are at most ranges + shards: a proven bound for the broadcast.
    met = placed.withColumn("_sh_block", block).join(F.broadcast(runs), ["_sh_shard", "_sh_block"])
    return met.select(*[F.col(f"`{c}`") for c in kept], F.col("_sh_shard").alias(shard), (F.col("_sh_at") + F.col("_sh_shift")).alias(slot))


def _xxh64_sql(source: str, name: str, value: str, seed: str, out: str) -> str:
    """Common table expressions that add ``out``, the XXH64 of a 64-bit integer, to the rows of ``source``."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5  # fixed values: the primes of XXH64
    wrap = lambda x: f"(({x}) % 18446744073709551616::uhugeint)::ubigint"
    times = lambda x, p: wrap(f"({x})::uhugeint * {p}::uhugeint")
    plus = lambda x, p: wrap(f"({x})::uhugeint + {p}::uhugeint")
    left = lambda x, n: f"({wrap(f'({x})::uhugeint * {1 << n}::uhugeint')} | ({x} >> {64 - n}))"
    steps = [
        times(f"case when {value} < 0 then ({value}::hugeint + 18446744073709551616::hugeint)::ubigint else {value}::ubigint end", p2),
        times(left("h", 31), p1),
        f"xor({plus(seed, p5 + 8)}, h)",
        plus(times(left("h", 27), p1), p4),
        "xor(h, h >> 33)",
        times("h", p2),
        "xor(h, h >> 29)",
        times("h", p3),
        "xor(h, h >> 32)",
    ]
    parts, at = [], source
    for i, step in enumerate(steps):
        parts.append(f"{name}{i} as (select * {'' if i == 0 else 'exclude (h)'}, {step} as h from {at})")
        at = f"{name}{i}"
    return ", ".join([*parts, f"{name} as (select * exclude (h), h as {out} from {at})"])


def oracle(shards: int) -> str:
    """DuckDB SQL for the rows of the query ``op11_rendezvous``: shards of equal weight over ``documents``, and one more."""
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    bytes_ = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)"
    return f"""with t as (select {table} as steps), d as (select doc_id, row_number() over () as rid, coalesce(octet_length(encode(text)), 0) + 8 as size,
      xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from documents, t),
    {_xxh64_sql("d", "k", "doc_id", "42", "by_key")}, s as (select rid, case when doc_id is null then 42::ubigint else by_key end as by_key, unnest(range({shards + 1})) as shard from k),
    {_xxh64_sql("s", "b", "shard", "by_key", "drawn")}, w as (select rid, first(shard order by drawn >> 12 desc, shard) filter (where shard < {shards}) as shard,
      first(shard order by drawn >> 12 desc, shard) as grown from b group by rid)
    select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
      row_number() over (partition by shard order by doc_id nulls first, text_crc32) - 1 as slot, grown::int as grown_shard from d join w using (rid)"""
