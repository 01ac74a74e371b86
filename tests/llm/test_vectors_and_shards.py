"""Sharding, hard negatives and whitening against plain versions."""

import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import negatives, registry, sharding, whitening

TABLES = "documents embeddings"


# ---- sharding ------------------------------------------------------------------------------------------------------


def test_op11_query_agrees_with_sql_and_keeps_the_law(spark, sf_dir):
    rows = registry.op11_rendezvous(spark, sf_dir).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    wanted = con.sql(f"select doc_id, size, text_crc32, law, shard, slot, grown_shard from ({registry.oracle_sql()['op11_rendezvous']})").fetchall()
    assert sorted(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")) for r in rows) == sorted(wanted)
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24


def _shards(spark, weights, added=None, n=20_000):
    ids = spark.range(n)
    key = F.col("id")
    chosen = sharding.grown_shard_of(key, weights, added) if added else sharding.shard_of(key, weights)
    return {r["id"]: r["s"] for r in ids.select("id", chosen.alias("s")).collect()}


def test_shares_follow_weights_and_changes_move_few_rows(spark):
    weights = [1.0, 2.0, 3.0, 0.0]
    before = _shards(spark, weights)
    counts = Counter(before.values())
    for shard, weight in enumerate(weights):
        share = weight / sum(weights)
        assert abs(counts[shard] / len(before) - share) <= 4 * math.sqrt(share * (1 - share) / len(before))
    grown = _shards(spark, weights, [2.0])
    moved = {k for k in before if before[k] != grown[k]}
    assert moved and {grown[k] for k in moved} == {4} and abs(len(moved) / len(before) - 0.25) < 0.02
    assert grown == _shards(spark, [*weights, 2.0])
    heavier = _shards(spark, [1.0, 2.0, 4.0, 0.0])
    assert {heavier[k] for k in before if before[k] != heavier[k]} == {2}
    gone = _shards(spark, [1.0, 0.0, 3.0, 0.0])
    assert {before[k] for k in before if before[k] != gone[k]} == {1}


@pytest.mark.parametrize("weights", [[], [0.0], [1.0, -1.0]])
def test_weights_that_mean_nothing_are_refused(weights):
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), weights)


def test_slots_are_gapless_for_a_hot_key_nulls_and_clashing_columns(spark):
    hot = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("x").alias("text"), F.lit("mine").alias("shard"), F.lit("mine").alias("slot"), F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.col("id").alias("a b"))
    rows = sharding.deal(hot.repartition(7), [1.0] * 5).collect()
    assert sorted(r["a b"] for r in rows) == list(range(6_000))
    slots, keys = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
        keys[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in keys.values())
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        ids = [-1 if k is None else k for _, k in found]
        assert ids == sorted(ids)


def test_an_empty_table_and_edge_rows_deal(edge_docs):
    assert sharding.deal(edge_docs.limit(0), [1.0, 1.0]).count() == 0
    dealt = sharding.deal(edge_docs, [1.0, 1.0])
    assert dealt.count() == edge_docs.count() and dealt.where("label = 'mine'").count() == edge_docs.count()


def test_a_hot_key_is_numbered_by_more_than_one_task(spark):
    hot = spark.range(0, 40_000, 1, 8).select(F.lit(1).alias("doc_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's anyway
    try:
        dealt = sharding.deal(hot, [1.0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt.inputFiles()) == 4 and dealt.agg(F.max("slot")).first()[0] == 39_999


# ---- hard negatives ------------------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, la, tuple(x)) for i, la, x in rows if i is not None and la is not None and x is not None and None not in x})
    out = []
    for i, la, x in rows:
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, k, y) for j, k, y in rows if len(y) == len(x)]
        near = sorted(s for s in scored if s[2] == la and s[1] != i)[:positives]
        for p in near:
            hits = sorted(s for s in scored if s[2] != la and low * -p[0] <= 100 * -s[0] <= high * -p[0])[:negatives]
            out += [(i, p[1], r, h[1], -p[0], -h[0]) for r, h in enumerate(hits, 1)]
    return sorted(out)


def _mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<long>")
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0, **more).collect())


def test_op12_query_agrees_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not Path(sf_dir).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    found = registry.op12_hard_negatives(spark, sf_dir)
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.sql(f"select {', '.join(found.columns)} from ({registry.oracle_sql()['op12_hard_negatives']})").fetchall())


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_negatives_equal_brute_force_with_ties(spark, spread):
    r = np.random.default_rng(spread)
    rows = [(int(i), int(r.integers(0, 3)), r.integers(-spread, spread + 1, 6).tolist()) for i in range(400)]
    rows += rows[:40] + [(3, 1, [1, 1, 1, 1, 1, 1]), (None, 1, [1] * 6), (5, None, [1] * 6), (6, 1, None), (7, 1, [1, None, 1, 1, 1, 1]), (20, 1, [1, 2]), (21, 1, [2, 2]), (22, 2, [1, 1]), (23, 2, []), (30, 2, [0] * 6)]
    assert _mined(spark, rows, block_rows=16) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_scores_beyond_single_and_double_precision_are_exact(spark):
    r = np.random.default_rng(5)
    for size in (1 << 11, 1 << 25):
        rows = [(int(i), int(i) % 3, (r.integers(-9, 10, 4) + size * r.integers(0, 2, 4)).tolist()) for i in range(120)]
        assert _mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_no_rows_and_no_anchors_give_no_rows(spark):
    assert _mined(spark, []) == [] and _mined(spark, [(1, 1, [1, 2]), (2, 2, [2, 1])]) == []


def test_a_tree_prunes_and_stays_exact():
    r = np.random.default_rng(1)
    middles = r.normal(size=(20, 16)) * 200
    label = np.repeat(np.arange(20) % 4, 200)
    x = (middles[np.repeat(np.arange(20), 200)] + r.normal(size=(4_000, 16)) * 10).astype(np.int64)
    ident = np.arange(4_000)
    tree = negatives.Block(ident, ident, label, x, leaf=32)
    asked = np.arange(0, 4_000, 400)
    dots = x[asked] @ x.T
    low = (dots.max(axis=1) * 0.2).astype(np.int64)[:, None]
    high = (dots.max(axis=1) * 0.6).astype(np.int64)[:, None]
    place, best = tree.search(ident[asked], label[asked], x[asked], low, high, 10, False)
    for i, q in enumerate(asked):
        wanted = sorted((-s, j) for j, s in enumerate(dots[i]) if label[j] != label[q] and low[i, 0] <= s <= high[i, 0])[:10]
        found = [(-int(s), int(tree.ident[p])) for s, p in zip(best[i, 0], place[i, 0]) if p >= 0]
        assert found == wanted
    assert tree.searched < 0.5 * len(asked) * len(x)


# ---- whitening -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("d", [0, 1, 2, 5, 40])
def test_eigen_solve_is_exact(d):
    r = np.random.default_rng(d)
    for a in (r.normal(size=(d, d)), np.zeros((d, d)), np.ones((d, d)), np.diag(np.arange(d) * 1.0)):
        a = a @ a.T
        values, vectors = whitening.eigen(a)
        assert np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-13) and np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-12 * max(1, np.abs(a).max(initial=0)))
        assert (np.diff(values) <= 1e-12 * max(1, np.abs(a).max(initial=0))).all()


def test_updates_and_merges_give_the_exact_covariance_far_from_zero():
    r = np.random.default_rng(2)
    x = r.integers(-60, 60, (500, 7)) + 10**9
    gap = x.astype(object) * len(x) - x.sum(axis=0).astype(object)
    exact = (gap.T @ gap / len(x) ** 3).astype(float)
    parts = []
    for rows in np.array_split(x, [1, 2, 130, 300]):
        parts.append(whitening.State.at(rows[0].astype(float)))
        parts[-1].add(rows.astype(float))
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    assert np.allclose(whole.covariance, exact, rtol=1e-12, atol=1e-11)


def test_op13_query_against_numpy(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = defaultdict(dict)
    for r in registry.op13_whitening(spark, sf_dir).collect():
        rows[r["vec_id"]][r["component"]] = r
    source = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    x = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], np.float64)).astype(np.int64) + 1_000_000 for r in source if r["embedding"] is not None and all(v is not None and math.isfinite(v) for v in r["embedding"])}
    assert set(rows) == set(x)
    all_x = np.stack(list(x.values()))
    n, total = len(all_x), all_x.sum(axis=0)
    centred = all_x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    found = np.array([[rows[i][k]["whitened"] for k in range(1, 33)] for i in x])
    wanted = centred @ vectors / np.sqrt(values)
    assert np.allclose(found * np.sign((found * wanted).sum(axis=0)), wanted, atol=1e-8)
    assert np.abs(found.T @ found / n - np.eye(32)).max() < 1e-9
    for i, v in x.items():
        r = rows[i][1]
        assert r["deviation"] == int(((n * v - total).astype(object) ** 2).sum()) and r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[0] / np.trace(centred.T @ centred / n), rel_tol=1e-9)


def test_whitening_edges(spark):
    vectors = [[1.0, 2.0], [1.0, 2.0], [3.0, 2.0], None, [None, 1.0], [math.nan, 1.0], [math.inf, 0.0], [], [5.0], [1e30, 2.0]]
    df = spark.createDataFrame([(i, v, "mine", "mine") for i, v in enumerate(vectors)], "vec_id int, x array<double>, whitened string, n string")
    model = whitening.fit(df, "x", 2)
    assert {d: w.n for d, w in model.items()} == {0: 1, 1: 1, 2: 4}
    found = {r["vec_id"]: r for r in whitening.whiten(df, "x", model).collect()}
    assert set(found) == {0, 1, 2, 7, 8, 9} and found[7]["whitened"] == [] and found[8]["whitened"] == [None] and found[0]["n"] == "mine"
    assert found[0]["whitened"] == found[1]["whitened"] and found[0]["whitened"][1] is None
    assert whitening.fit(df.limit(0), "x") == {} and whitening.whiten(df.limit(0), "x", {}).count() == 0 and whitening.identity_error(df.limit(0), "x") == 0.0


def test_deviation_is_null_where_64_bits_do_not_hold_it():
    w = whitening.Whitener(3, [3 << 40], np.zeros(1), np.zeros(1), np.eye(1), np.ones(1), np.zeros(1, bool))
    assert w.deviation(np.array([[1 << 40], [(1 << 40) + 5], [0]])) == [0, 225, None]
