"""The operators as queries over the driver's tables; each query is a thin digest of its operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, common, contamination, katz, licenses, linededup, minhash, negatives, quality, secrets, sharding, simhash, toxicity, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.remainder(F.col("doc_id"), 3) == 1
    docs = documents(spark, sf_dir)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), held_out=held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.neighbours(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_document(documents(spark, sf_dir)).select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("found").alias("n_blocks"), "found")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.remainder(F.col("doc_id"), 7) == 2
    model = katz.fit_and_score(documents(spark, sf_dir), ~held_out)
    total = F.lit(model.plan.words.total).cast("long")
    return model.scores.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", total.alias("train_tokens"), "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.remainder(F.col("doc_id"), 3) == 1
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), held_out=held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", F.size("removed").alias("n_removed_runs"), "removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = contamination.load(common.table(spark, sf_dir, "benchmark"))
    return contamination.find_leaks(documents(spark, sf_dir), items).drop("row_text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.deal(slim, [1.0] * 24)
    grown = sharding.grown_shard_of(F.col("doc_id"), [1.0] * 24, [1.0])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").where(whitening.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")))
    return negatives.mine(rows.select("vec_id", label.alias("label"), whole.alias("x")), F.col("id") % 100 == 0)


_HARD_NEGATIVES = """with e as materialized (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
  s as materialized (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
  p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
  select anchor_id, positive_id, row_number() over w::int as rank, vec_id as negative_id, positive_score, score as negative_score from p join s using (anchor_id)
    where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
    window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify rank <= 10"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where(whitening.finite(F.col("embedding")))
    whole = lambda c: F.greatest(F.least(F.floor(F.lit(64.0) * c.cast("double")), F.lit(1 << 40)), F.lit(-(1 << 40))).cast("long") + 1_000_000
    x = rows.select("vec_id", F.transform("embedding", whole).alias("x"))
    found = whitening.whiten(x, "x", whitening.fit(x, "x", 32), deviation=True)
    error = whitening.identity_error(found)
    each = found.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", F.lit(error).alias("identity_error"))


def queries():
    return {f.__name__: f for f in (op1_quality, op2_fingerprints, op3_simhash, op4_secrets, op5_licenses, op6_language_model, op7_toxicity, op8_line_dedup, op9_decontamination, op10_bpe, op11_rendezvous, op12_hard_negatives, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op11_rendezvous": sharding.oracle(24), "op12_hard_negatives": _HARD_NEGATIVES}
