"""Language-model scoring: a Katz bigram model with Good-Turing discounts, counted and evaluated by exchanges of packed arrays.

Tokens are words with A-Z lower-cased, then one end token per text; the first token's context is a start mark. With c
occurrences in the training texts, N tokens and V distinct ones::

    p(w)     = d1(c(w)) c(w) / (N + 1)                          w occurs; what is left over belongs to all other words
    p(w | h) = d2(c(h, w)) c(h, w) / (c(h) + 1)                 the pair occurs
             = a(h) p(w)                                        else, and p(w) if h does not occur
    a(h)     = (1 - sum of p(w | h)) / (1 - sum of p(w))        over the words w that occur after h

``d`` are Good-Turing discounts for counts up to ``TOP`` (Katz 1987; a discount outside 0..1 gives way to
``(r - 1/2) / r``) and 1 above. One pseudo-count per context goes to backing off, so no context is left without mass and
every distribution sums to 1 exactly.

How it runs. Each task packs its texts into chunks of about ``chunk_tokens`` token numbers with the chunk's own vocabulary,
written once as a table bucketed by chunk. A chunk is what one Python call holds, so its size is set by the workers' memory;
larger chunks repeat fewer pairs. Counting and looking up are the same exchange: a chunk sends each bucket its distinct n-grams with
their training counts, in an order it can repeat; the bucket adds them up and sends the totals back in that order. So a
frequent word or pair costs one entry per chunk, never one per occurrence. Pairs are dealt by context, but for contexts
with over ``hot`` of the training tokens, which are dealt by pair; at most ``1 / hot`` contexts are hot, a proven
bound for the broadcast of their sums. The unigram and bigram tables are left in the shared folder, partitioned by kind and
dealt by bucket. Words are told apart by XXH64 within the unigram exchange and by dense numbers after it.

Null and empty texts have the end token alone. A text that trains and repeats counts each time. Repeated rows score alike.
Without training texts every token falls to the unknown word, with probability 1. Other columns are not kept.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import common
from brindle.llm.common import mix

TOP = 5
CHUNK_TOKENS, BUCKET_ENTRIES = 5 << 18, 400_000
END, START = b"\n", b" "  # no word holds either
_ENDED = np.int64(np.uint64(xxhash.xxh64_intdigest(END)).view(np.int64))


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0 to ``TOP + 1`` (the last stands for all above) from how many n-grams have each count."""
    d = np.ones(TOP + 2)
    d[0] = 0
    cut = (TOP + 1) * kinds[TOP + 1] / kinds[1] if kinds[1] else 0.0
    for r in range(1, TOP + 1):
        found = ((r + 1) * kinds[r + 1] / (r * kinds[r]) - cut) / (1 - cut) if kinds[r] and cut != 1 else -1.0
        d[r] = found if 0 < found < 1 else (r - 0.5) / r
    return d


@dataclass
class Level:
    """What the driver knows of one order: token and type totals, and discounts."""

    total: int = 0
    types: int = 0
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(TOP + 2))

    def __post_init__(self):
        self.discount = discounts(self.kinds)

    def discounted(self, count: np.ndarray) -> np.ndarray:
        return self.discount[np.minimum(count, TOP + 1)] * count


def kinds_of(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts[counts > 0], TOP + 2), minlength=TOP + 3)[: TOP + 2].tolist()


def pack(docs: DataFrame, trains: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of ``docs(doc_id, text)``: token numbers, the chunk's vocabulary and its training counts."""
    docs = docs.select("doc_id", "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk bigint, doc_ids array<{id_type}>, trains array<boolean>, sizes array<int>, tokens array<int>, words array<bigint>, counts array<int>, n_words int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), itertools.count()

        def fresh():
            numbers = defaultdict(itertools.count().__next__)
            numbers[END]  # number 0
            return numbers, [], [], [], []

        def packed():
            tokens = np.fromiter(itertools.chain.from_iterable(texts), np.int32, sum(sizes))
            counts = np.bincount(tokens[np.repeat(np.array(train, bool), sizes)], minlength=len(numbers)).astype(np.int32)
            digest = xxhash.xxh64_intdigest
            words = np.array([digest(w) for w in numbers], np.uint64).view(np.int64)
            row = [[(task << 32) | next(chunk)], [pa.concat_arrays(ids)], [train], [np.array(sizes, np.int32)], [tokens], [words], [counts], [len(words)]]
            kinds = [pa.int64(), pa.list_(ids[0].type), pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
            names = ["chunk", "doc_ids", "trains", "sizes", "tokens", "words", "counts", "n_words"]
            arrays = [pa.array(v, k) if not isinstance(v[0], (np.ndarray, pa.Array)) else one(v[0], k) for v, k in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        numbers, ids, train, sizes, texts = fresh()
        held = 0
        for part in common.pieces(batches, "text"):
            for text in part.column("text").cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist():
                found = list(map(numbers.__getitem__, text.lower().split()))
                found.append(0)
                texts.append(found)
                sizes.append(len(found))
                held += len(found)
            ids.append(part.column("doc_id"))
            train += part.column("trains").to_pylist()
            if held >= chunk_tokens:
                yield packed()
                (numbers, ids, train, sizes, texts), held = fresh(), 0
        if sizes:
            yield packed()

    return docs.mapInArrow(run, schema)


def one(values, kind: pa.DataType) -> pa.Array:
    """An Arrow array of one list."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind.value_type) if len(flat) else pa.array([], kind.value_type))


def flat(column) -> np.ndarray:
    """All values of a column of lists, in order."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def lengths(column) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(np.array(column.combine_chunks().value_lengths().fill_null(0)))]) if len(column) else np.zeros(0, np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27)) % np.uint64(buckets)).astype(np.int64)


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with its positions in ascending order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(bucket[part[0]]), part


WORD_ROWS = "kind string, bucket int, chunk bigint, totals array<bigint>, index array<int>, words array<bigint>, n_words int, kinds array<bigint>"
_INTS, _LONGS, _DOUBLES = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """The unigram exchange: rows ``kind = 'table'`` (a bucket's words and counts) and ``'reply'`` (totals for a chunk)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                words, counts = flat(row.column("words")), flat(row.column("counts"))
                parts = list(split_by(bucket_of(words, buckets)))
                n = len(parts)
                same = pa.array([row.column("chunk")[0].as_py()] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), same, lists([words[p] for _, p in parts], _LONGS), lists([counts[p] for _, p in parts], _INTS)], ["bucket", "chunk", "words", "counts"])

    asked = chunks.select("chunk", "words", "counts").mapInArrow(ask, "bucket int, chunk bigint, words array<bigint>, counts array<int>")

    def add_up(part: pa.Table) -> pa.Table:
        words, back = np.unique(flat(part["words"]), return_inverse=True)
        totals = np.bincount(back, flat(part["counts"]), minlength=len(words)).astype(np.int64)
        cut = np.cumsum(lengths(part["words"]))[:-1]
        bucket, n = part["bucket"][0].as_py(), part.num_rows
        # A word's index counts the bucket's words before it, in the order of their hashes.
        replies = pa.table([pa.array(["reply"] * n), part["bucket"], part["chunk"], lists(np.split(totals[back], cut), _LONGS), lists(np.split(back, cut), _INTS), pa.nulls(n, _LONGS), pa.nulls(n, pa.int32()), pa.nulls(n, _LONGS)], names=names)
        table = pa.table([pa.array(["table"]), pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), one(totals, _LONGS), pa.nulls(1, _INTS), one(words, _LONGS), pa.array([len(words)], pa.int32()), one(np.array(kinds_of(totals), np.int64), _LONGS)], names=names)
        return pa.concat_tables([replies, table.cast(replies.schema)])

    names = ["kind", "bucket", "chunk", "totals", "index", "words", "n_words", "kinds"]
    return asked.groupBy("bucket").applyInArrow(add_up, WORD_ROWS)


class Chunk:
    """One chunk with the replies to its words: everything that the bigram exchange and the scores are made of."""

    def __init__(self, row: dict, replies: list[tuple[int, np.ndarray, np.ndarray]], plan: Plan):
        self.tokens, sizes = row["tokens"], row["sizes"]
        words = row["words"]
        self.count = np.zeros(len(words) + 1, np.int64)
        self.number = np.zeros(len(words) + 1, np.int64)
        at = dict(split_by(bucket_of(words, plan.word_buckets)))
        for bucket, totals, index in replies:
            self.count[at[bucket]] = totals
            self.number[at[bucket]] = plan.offsets[bucket] + index
        start = len(words)  # the start mark's place
        self.count[start], self.number[start] = plan.train_docs, plan.offsets[-1]
        self.first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.first] = start
        base = len(words) + 1
        before *= base
        before += self.tokens
        pairs, back = np.unique(before, return_inverse=True)
        del before
        self.back = back.astype(np.int32)
        self.context, self.word = (pairs // base).astype(np.int32), (pairs % base).astype(np.int32)
        self.pair_count = np.bincount(self.back[np.repeat(row["trains"], sizes)], minlength=len(pairs))
        del pairs, back
        self.hot = self.count >= plan.hot_count
        key = np.where(self.hot[self.context], mix(self.number[self.context].view(np.uint64)).view(np.int64) ^ self.number[self.word], self.number[self.context])
        self.parts = list(split_by(bucket_of(key, plan.pair_buckets)))

    def grouped(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of a bucket's pairs, in order, and where each begins."""
        context = self.context[part]
        begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        return context[begin], begin


@dataclass
class Plan:
    """What every task needs to know: bucket numbers, the words before each bucket, and totals."""

    word_buckets: int
    pair_buckets: int
    offsets: np.ndarray
    words: Level
    train_docs: int
    hot_count: int
    hot: dict[int, np.ndarray] = field(default_factory=dict)
    pairs: Level = field(default_factory=Level)

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        return self.words.discounted(count) / (self.words.total + 1)

    @property
    def number_kind(self) -> tuple[str, pa.DataType]:
        return ("int", _INTS) if self.offsets[-1] < (1 << 31) - 2 else ("bigint", _LONGS)

    @property
    def count_kind(self) -> tuple[str, pa.DataType]:
        return ("int", _INTS) if self.words.total < 1 << 31 else ("bigint", _LONGS)

    @property
    def pair_rows(self) -> str:
        id_kind = self.number_kind[0]
        return f"kind string, bucket int, chunk bigint, totals array<bigint>, weak array<int>, weak_kinds array<int>, weak_high array<bigint>, weak_lower array<double>, contexts array<{id_kind}>, sizes array<int>, words array<{id_kind}>, kinds array<bigint>"

    @property
    def unknown(self) -> float:
        kinds, d = self.words.kinds, self.words.discount
        low = (np.arange(1, TOP + 1) * (1 - d[1 : TOP + 1]) * kinds[1 : TOP + 1]).sum()
        return float((low + 1) / (self.words.total + 1))


def chunk_rows(table: pa.Table) -> Iterator[dict]:
    for i in range(table.num_rows):
        row = table.slice(i, 1)
        out = {n: flat(row[n]) for n in ("trains", "sizes", "tokens", "words")}
        yield out | {"chunk": row["chunk"][0].as_py(), "doc_ids": row["doc_ids"].combine_chunks().flatten()}


def word_replies(table: pa.Table, chunk: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    out = []
    for i in np.flatnonzero((table["chunk"].to_numpy() == chunk) & (table["kind"].to_numpy() == "reply")):
        row = table.slice(int(i), 1)
        out.append((row["bucket"][0].as_py(), flat(row["totals"]), flat(row["index"])))
    return out


def count_pairs(chunks: DataFrame, replies: DataFrame, plan: Plan) -> DataFrame:
    """The bigram exchange: ``'table'`` rows (contexts, sizes, words, counts), ``'pairs'`` replies and ``'hot'`` partial sums."""
    shared = chunks.sparkSession.sparkContext.broadcast(plan)
    id_kind, id_list = plan.number_kind
    count_kind, count_list = plan.count_kind
    asked_names = ["bucket", "chunk", "contexts", "sizes", "words", "lower", "counts"]

    kinds = [pa.int32(), pa.int64(), id_list, _INTS, id_list, count_list, _INTS]
    asked_schema = pa.schema(list(zip(asked_names, kinds)))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [asked_schema.empty_table()]
        for row in chunk_rows(left):
            # One chunk at a time goes to Arrow, so its numpy arrays are gone before the next one's are made.
            c = Chunk(row, word_replies(right, row["chunk"]), shared.value)
            number = c.number.astype(np.int32) if id_list is _INTS else c.number
            count = c.count.astype(np.int32) if count_list is _INTS else c.count
            contexts = [c.grouped(part) for _, part in c.parts]
            columns = [
                pa.array([b for b, _ in c.parts], pa.int32()),
                pa.array([row["chunk"]] * len(c.parts), pa.int64()),
                lists([number[places] for places, _ in contexts], id_list),
                lists([np.diff(np.r_[begin, len(part)]).astype(np.int32) for (_, begin), (_, part) in zip(contexts, c.parts)], _INTS),
                lists([number[c.word[part]] for _, part in c.parts], id_list),
                lists([count[c.word[part]] for _, part in c.parts], count_list),
                lists([c.pair_count[part].astype(np.int32) for _, part in c.parts], _INTS),
            ]
            out.append(pa.table(columns, schema=asked_schema))
            del c, contexts, columns
        return pa.concat_tables(out)

    asked = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ask, f"bucket int, chunk bigint, contexts array<{id_kind}>, sizes array<int>, words array<{id_kind}>, lower array<{count_kind}>, counts array<int>")

    names = ["kind", "bucket", "chunk", "totals", "weak", "weak_kinds", "weak_high", "weak_lower", "contexts", "sizes", "words", "kinds"]
    kinds = [pa.string(), pa.int32(), pa.int64(), _LONGS, _INTS, _INTS, _LONGS, _DOUBLES, id_list, _INTS, id_list, _LONGS]

    def add_up(part: pa.Table) -> pa.Table:
        p = shared.value
        sizes = flat(part["sizes"])
        context = np.repeat(flat(part["contexts"]), sizes).astype(np.int64)
        word, lower, count = flat(part["words"]).astype(np.int64), flat(part["lower"]).astype(np.int64), flat(part["counts"])
        order = np.lexsort((word, context))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[new]
        total = np.bincount(group, count, minlength=len(head)).astype(np.int64)
        c, w = context[head], word[head]
        fresh = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        seen = total > 0
        add = lambda x: np.add.reduceat(x, fresh) if len(fresh) else x
        by_kind = np.stack([add(((total == r)).astype(np.int64)) for r in range(1, TOP + 1)], axis=1)
        high = add(np.where(total > TOP, total, 0))
        mass = add(np.where(seen, p.word_probability(lower[head]), 0.0))
        rows: list[list] = []
        owner = np.cumsum(np.r_[False, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        n_entries, n_contexts = lengths(part["words"]), lengths(part["contexts"])
        at = at_context = 0
        for i in range(part.num_rows):
            mine = group[at : at + n_entries[i]]
            own = sizes[at_context : at_context + n_contexts[i]]
            begin = np.r_[0, np.cumsum(own)[:-1]].astype(np.int64)
            answer = total[mine]
            weak = np.flatnonzero(np.add.reduceat((answer == 0).astype(np.int64), begin)) if len(own) else begin
            which = owner[mine[begin[weak]]]
            rows.append(["pairs", part["bucket"][i].as_py(), part["chunk"][i].as_py(), answer, weak, by_kind[which].ravel(), high[which], mass[which], [], [], [], []])
            at, at_context = at + n_entries[i], at_context + n_contexts[i]
        bucket = part["bucket"][0].as_py()
        kept = np.bincount(owner[seen], minlength=len(fresh))
        full = kept > 0
        heads = c[fresh]
        rows.append(["table", bucket, None, total[seen], [], [], [], [], heads[full], kept[full], w[seen], kinds_of(total)])
        hot = np.flatnonzero(np.isin(heads, p.hot_numbers))
        rows.append(["hot", bucket, None, [], [], by_kind[hot].ravel(), high[hot], mass[hot], heads[hot], [], [], []])
        columns = list(zip(*rows))
        return pa.table([pa.array(v, k) if not pa.types.is_list(k) else lists([np.asarray(x) for x in v], k) for v, k in zip(columns, kinds)], names=names)

    return asked.groupBy("bucket").applyInArrow(add_up, plan.pair_rows)


def backoff(plan: Plan, count: np.ndarray, kinds: np.ndarray, high: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The weights a(h) of contexts with the given count, kinds of pair counts, pairs above, and lower mass of seen words."""
    seen = (kinds * np.arange(1, TOP + 1) * plan.pairs.discount[1 : TOP + 1]).sum(axis=1) + high
    return (1 - seen / (count + 1)) / np.maximum(1 - lower, 1e-300)


def evaluate(chunks: DataFrame, replies: DataFrame, plan: Plan) -> DataFrame:
    """Scores of all texts from the totals that came back to their chunks."""
    shared = chunks.sparkSession.sparkContext.broadcast(plan)
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "trains", "n_tokens", "n_known", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, out = shared.value, []
        kind, chunk = right["kind"].to_numpy(), right["chunk"].to_numpy()
        for row in chunk_rows(left):
            c = Chunk(row, word_replies(right, row["chunk"]), p)
            total = np.zeros(len(c.context), np.int64)
            weight = np.ones(len(c.count))
            for place in np.flatnonzero(c.hot):
                k = p.hot.get(int(c.number[place]))
                if k is not None:
                    weight[place] = backoff(p, c.count[place : place + 1], k[None, :TOP], k[TOP : TOP + 1], k[TOP + 1 :])[0]
            at = dict(c.parts)
            for i in np.flatnonzero((kind == "pairs") & (chunk == row["chunk"])):
                reply = right.slice(int(i), 1)
                part = at[reply["bucket"][0].as_py()]
                total[part] = flat(reply["totals"])
                places = c.grouped(part)[0][flat(reply["weak"])]
                cold = ~c.hot[places] & (c.count[places] > 0)
                found = backoff(p, c.count[places], flat(reply["weak_kinds"]).reshape(-1, TOP), flat(reply["weak_high"]), flat(reply["weak_lower"]))
                weight[places[cold]] = found[cold]
            count = c.count[:-1]
            word = np.where(count > 0, p.word_probability(count), p.unknown)
            follows = c.count[c.context]
            pair = np.where(total > 0, p.pairs.discounted(total) / (follows + 1), weight[c.context] * word[c.word])
            base = np.log10((count + 1) / (p.words.total + p.words.types + 1))
            add = lambda x: np.add.reduceat(x, c.first) if len(c.first) else np.zeros(0)  # noqa: B023, E731
            out.append(pa.table([row["doc_ids"], pa.array(row["trains"], pa.bool_()), pa.array(row["sizes"].astype(np.int64)), pa.array(add((count > 0)[c.tokens].astype(np.int64))), pa.array(add(base[c.tokens])), pa.array(add(np.log10(pair)[c.back]))], names=names))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, f"doc_id {id_type}, trains boolean, n_tokens long, n_known long, base_score double, score double")


@dataclass
class Katz:
    """A fitted model: where its tables lie, and what scoring its texts needs."""

    path: str
    plan: Plan
    scores: DataFrame


def fit_and_score(docs: DataFrame, trains: Column, *, hot: float = 1e-3, chunk_tokens: int | None = None) -> Katz:
    """Count the texts where ``trains`` holds and score all texts of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    path = common.scratch(spark)
    name = f"katz_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pack(docs, trains, chunk_tokens or CHUNK_TOKENS).write.option("path", f"{path}/chunks").option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("trains", lambda x: x))), F.lit(0))).first()
    n_words, n_tokens, train_docs = map(int, size)

    word_buckets = max(1, -(-n_words // BUCKET_ENTRIES))
    count_words(chunks, word_buckets).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/words")
    counted = spark.read.schema(WORD_ROWS).parquet(f"{path}/words")
    table = counted.where("kind = 'table'").select("bucket", "n_words", "kinds", F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("totals", lambda x: x > 0)).alias("types")).collect()
    # One row of a few numbers per bucket reaches the driver.
    offsets = np.zeros(word_buckets + 1, np.int64)
    for r in table:
        offsets[r["bucket"] + 1] = r["n_words"]
    words = Level(sum(r["total"] for r in table), sum(r["types"] for r in table), np.sum([r["kinds"] for r in table] or [np.zeros(TOP + 2)], axis=0).astype(float))
    plan = Plan(word_buckets, max(1, -(-n_tokens // (2 * BUCKET_ENTRIES))), np.cumsum(offsets), words, train_docs, max(1000, int(words.total * hot)))
    heavy = counted.where("kind = 'table'").select("bucket", F.posexplode("totals").alias("index", "total")).where(F.col("total") >= plan.hot_count)
    numbers = [int(plan.offsets[r["bucket"]] + r["index"]) for r in heavy.collect()]  # at most 1 / hot rows
    plan.hot_numbers = np.array(numbers + [int(plan.offsets[-1])] * (train_docs >= plan.hot_count), np.int64)

    replies = counted.where("kind = 'reply'").select("kind", "bucket", "chunk", "totals", "index")
    count_pairs(chunks, replies, plan).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pairs")
    paired = spark.read.schema(plan.pair_rows).parquet(f"{path}/pairs")
    kinds = paired.where("kind = 'table'").select(F.posexplode("kinds").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
    spread = np.zeros(TOP + 2)
    for r in kinds:
        spread[r["r"]] = r["n"]
    plan.pairs = Level(words.total, int(spread.sum()), spread)
    for r in paired.where("kind = 'hot'").where(F.size("contexts") > 0).select("contexts", "weak_kinds", "weak_high", "weak_lower").collect():
        k = np.array(r["weak_kinds"], float).reshape(-1, TOP)
        for i, context in enumerate(r["contexts"]):
            plan.hot[context] = plan.hot.get(context, 0) + np.r_[k[i], r["weak_high"][i], r["weak_lower"][i]]

    both = replies.unionByName(paired.where("kind = 'pairs'").select("kind", "bucket", "chunk", "totals", "weak", "weak_kinds", "weak_high", "weak_lower"), allowMissingColumns=True)
    return Katz(path, plan, evaluate(chunks, both, plan))
