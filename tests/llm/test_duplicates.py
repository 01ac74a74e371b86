"""Fingerprints, near-duplicates, repeated lines, benchmark leaks and the pipeline: brute force on small tables."""

import collections
import functools
import hashlib
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import common, contamination, linededup, minhash, registry, simhash
from brindle.llm.components import components

WORDS = re.compile("[^\x20\x09-\x0d]+")


def word(rnd):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))


def sentence(rnd, n):
    return " ".join(word(rnd) for _ in range(n))


# ---- components ----------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (500, 501), (501, 500), (None, 3), (900, 900)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160))
    assert got[501] == 500 and got[900] == 900 and components(edges.limit(0)).count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr("brindle.llm.components.HOT", 5)
    rnd = random.Random(9)
    edges = [(0, i) for i in range(1, 300)] + [(rnd.randrange(300, 600), rnd.randrange(300, 600)) for _ in range(150)] + [(299, 900), (900, 901)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(700):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


# ---- minhash -------------------------------------------------------------------------------------------------------


def shingles(text, width):
    w = WORDS.findall(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_neighbours(rows, got):
    mark = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 1
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, mark(r[1] or ""), r[1] or ""), reverse=True)
    wanted = collections.defaultdict(list)
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        wanted[doc_id].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(shingles(text, 5), shingles(edited, 5)), jaccard(shingles(text, 5), shingles(after, 5))))
    gaps = []
    for doc_id, of in wanted.items():
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: (r.n_chars, r.edited_sha256))
        assert [(r.n_chars, r.edited_sha256) for r in mine] == sorted((w[0], w[1]) for w in of)
        gaps += [abs(r.near_edited - w[2]) for r, w in zip(mine, sorted(of, key=lambda w: w[:2]))] + [abs(r.near_next - w[3]) for r, w in zip(mine, sorted(of, key=lambda w: w[:2]))]
    return gaps


def test_op2_query(spark, sf_dir):
    rows = [tuple(r) for r in registry.documents(spark, sf_dir).collect()]
    got = registry.op2_fingerprints(spark, sf_dir).collect()
    gaps = check_neighbours(rows, got)
    assert len(got) == len(rows) and np.mean(gaps) < 0.03 and max(gaps) < 0.25


def test_fingerprint_edges(edge_docs, docs_of):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = minhash.neighbours(edge_docs).collect()
    assert len(got) == 11 and max(check_neighbours(rows, got)) < 0.25
    prints = {r.doc_id: r.fingerprint for r in minhash.fingerprints(edge_docs).where("doc_id < 8").collect()}
    assert prints[1] == prints[6] and prints[2] == prints[3] == prints[4] == "00" * minhash.BINS and prints[7] != prints[2]
    assert minhash.neighbours(edge_docs.limit(0)).count() == 0
    alone = minhash.neighbours(docs_of(["only one text of some words here"])).first()
    assert alone.near_next == 1.0


def plain_fingerprint(text):
    """One-permutation MinHash with the same hashes, bin by bin."""
    h64 = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    chain = lambda parts: functools.reduce(lambda seed, x: h64(x, seed), parts, 42)
    words = [h64(w.encode()).to_bytes(8, "little") for w in re.split("[\x20\x09-\x0d]+", text.strip("\x20\t\n\x0b\x0c\r")) if w]
    if not words:
        return "00" * 128
    bins = {}
    for x in (chain(words[i : i + 5]) >> 1 for i in range(max(1, len(words) - 4))):
        bins[x >> 56] = min(x, bins.get(x >> 56, x))
    signed = lambda x: x - (x >> 63 << 64)
    four = lambda x: x.to_bytes(4, "little")
    out = []
    for b in range(128):
        order = [b] + [signed(chain([four(b), four(k)])) % 128 for k in range(12)] + [min(bins, key=lambda x: signed(chain([four(b), four(x)])))]
        out.append(next(bins[x] for x in order if x in bins) & 255)
    return bytes(out).hex()


def test_op2_fingerprints_match_plain_minhash(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in registry.documents(spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    for r in registry.op2_fingerprints(spark, sf_dir).collect():
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        assert r.fingerprint == plain_fingerprint(text)
        assert r.edited_fingerprint == plain_fingerprint(text[: len(text) - half] + after[:half])


def test_next_rows_of_hot_and_null_ids(docs_of):
    texts = [f"text {i * 7919 % 300} of some words" for i in range(300)]
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(300)]
    rows = list(zip(ids, texts))
    assert max(check_neighbours(rows, minhash.neighbours(docs_of(texts, ids)).collect())) < 0.3


def test_minhash_is_unbiased_for_short_texts(spark, docs_of):
    rnd = random.Random(2)
    texts = []
    for _ in range(150):
        base = [word(rnd) for _ in range(30)]
        texts += [" ".join(base), " ".join(base[:20] + [word(rnd) for _ in range(10)])]
    f = minhash.signature(docs_of(texts), "text", "s").select((F.floor(F.col("doc_id") / 2)).alias("k"), (F.col("doc_id") % 2).alias("side"), "s")
    pairs = f.where("side = 0").alias("a").join(f.where("side = 1").alias("b"), "k").select(minhash.likeness(F.col("a.s"), F.col("b.s")).alias("x")).collect()
    assert abs(np.mean([r.x for r in pairs]) - 16 / 36) < 0.03


def test_op2_is_native(spark, sf_dir):
    for name in (registry.op2_fingerprints, registry.op8_line_dedup):
        plan = name(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- simhash -------------------------------------------------------------------------------------------------------


def brute_print(text, width=3):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_op3_query(spark, sf_dir):
    prints = {r.doc_id: brute_print(r.text) for r in registry.documents(spark, sf_dir).collect()}
    wanted = brute_components(prints, 3)
    got = registry.op3_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == wanted


@pytest.mark.parametrize("radius, agree", [(3, 2), (7, 3)])
def test_links_give_exact_components(spark, radius, agree, monkeypatch):
    rnd = random.Random(radius)
    values = set()
    for _ in range(25):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            values.add(centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, radius))) & (1 << 64) - 1)
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "SLICE", 8)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), radius=radius, agree=agree)
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(edges).collect()}
    groups = collections.defaultdict(set)
    for v in values:
        groups[got.get(v, v)].add(v)
    wanted = collections.defaultdict(set)
    for v, r in brute_components({v: v for v in values}, radius).items():
        wanted[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_representatives_in_small_and_large_keys(docs_of, monkeypatch):
    rnd = random.Random(4)
    texts = []
    for size in (1, 1, 2, 5, 60):
        base = [word(rnd) for _ in range(200)]
        for _ in range(size):
            copy = list(base)
            copy[rnd.randrange(200)] = word(rnd)
            texts.append(" ".join(copy))
    half = [word(rnd) for _ in range(100)]
    texts += [" ".join(half + [word(rnd) for _ in range(30)]) for _ in range(2)] + [texts[0]] * 40
    for slice_rows in (1024, 8):
        monkeypatch.setattr(simhash, "SLICE", slice_rows)
        assert sorted(r.doc_id for r in simhash.representatives(docs_of(texts)).collect()) == [0, 1, 2, 4, 9, 69, 70]


def brute_similar(texts, least=0.8):
    """The smallest number of each component of texts whose sets of five words have that Jaccard similarity."""
    sets = [shingles(t, 5) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if jaccard(sets[a], sets[b]) >= least and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def test_representatives_find_every_kind_of_edit(docs_of):
    rnd = random.Random(12)
    texts = []
    for k in range(120):
        base = [word(rnd) for _ in range(150)]
        share = rnd.uniform(0.1, 0.2)
        scattered = list(base)
        for i in rnd.sample(range(150), rnd.randint(1, 4)):
            scattered[i] = word(rnd)
        copy = (scattered, base[: round(150 * (1 - share))], base + [word(rnd) for _ in range(round(150 * share))])[k % 3]
        texts += [" ".join(base), " ".join(copy)]
    wanted = brute_similar(texts)
    assert 120 <= len(wanted) < 150
    assert sorted(r.doc_id for r in simhash.representatives(docs_of(texts)).collect()) == wanted


def test_representatives_are_exact_in_large_keys(docs_of, monkeypatch):
    rnd = random.Random(13)
    base = [word(rnd) for _ in range(200)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for i in rnd.sample(range(200), rnd.randint(2, 5)):
            copy[i] = word(rnd)
        texts.append(" ".join(copy))
    wanted = brute_similar(texts)
    assert len(wanted) == 39
    for small, slice_rows in ((24, 1024), (4, 8)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "SLICE", slice_rows)
        assert sorted(r.doc_id for r in simhash.representatives(docs_of(texts)).collect()) == wanted


def test_a_key_of_over_a_thousand_near_copies(docs_of):
    rnd = random.Random(41)
    base = [word(rnd) for _ in range(120)]
    texts = []
    for i in range(1500):
        words = list(base)
        if i % 3:
            words[rnd.randrange(120)] = word(rnd)
        texts.append(" ".join(words[: 120 - i % 5]))
    texts += [sentence(rnd, 120) for _ in range(100)]
    kept = {r.doc_id for r in simhash.representatives(docs_of(texts)).collect()}
    assert kept == {0, *range(1500, 1600)}


def test_no_pair_is_missed_on_a_larger_table(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no larger table")
    docs = common.table(spark, str(folder), "documents")
    sets = {r.doc_id: shingles(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""), 5) for r in docs.collect()}
    of = collections.defaultdict(set)
    for i, s in sets.items():
        for g in s:
            of[g].add(i)
    rows = [(a, b) for a, s in sets.items() for b, n in collections.Counter(x for g in s for x in of[g] if x < a).items() if n >= 0.8 * (len(s) + len(sets[b]) - n)]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [i for i, s in sets.items() if not s]
    for a, b in rows + [(i, empty[0]) for i in empty]:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == {i for i in sets if find(i) == i} and sum(sets[a] != sets[b] for a, b in rows) >= 3


def test_nearer_texts_do_not_hide_a_similar_one(spark, docs_of, monkeypatch):
    rnd = random.Random(14)
    a = [word(rnd) for _ in range(200)]
    texts = [" ".join(a), " ".join(a[:190]), " ".join(a[:100] + [word(rnd) for _ in range(100)])] + [sentence(rnd, 50) for _ in range(27)]
    keys = [[0, 1, 10], [0, 2, 20], [0, 1, 20]] + [[0, 100 + i, 200 + i] for i in range(27)]
    hand = spark.createDataFrame(list(enumerate(keys)), "doc_id long, keys array<long>")

    def marks(docs, width, bands, rows):
        found = docs.select("doc_id", F.xxhash64("text").alias("node"), F.size(F.split("text", " ")).cast("long").alias("length"))
        return found.join(hand, "doc_id")

    monkeypatch.setattr(simhash, "marks", marks)
    assert sorted(r.doc_id for r in simhash.representatives(docs_of(texts)).collect()) == [0, *range(2, 30)]


def bands_of_one(docs, width, bands, rows):
    """Marks whose keys no two texts share."""
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", node.alias("node"), F.size(F.split("text", " ")).cast("long").alias("length"), F.array(node).alias("keys"))


def test_near_duplicate_stage_links_close_fingerprints(spark, sf_dir, docs_of, monkeypatch):
    rnd = random.Random(15)
    texts, wanted = [], []
    for _ in range(60):
        base = [word(rnd) for _ in range(400)]
        copy = list(base)
        copy[rnd.randrange(400)] = word(rnd)
        a, b = (simhash.fingerprint(" ".join(t).encode(), 3) for t in (base, copy))
        wanted += [len(texts)] + [len(texts) + 1] * ((a ^ b).bit_count() > 3)
        texts += [" ".join(base), " ".join(copy)]
    assert 70 <= len(wanted) <= 110
    monkeypatch.setattr(simhash, "marks", bands_of_one)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs_of(texts), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == wanted


@pytest.mark.parametrize("small, slice_rows", [(24, 1024), (1, 1024), (1, 4)])
def test_close_fingerprints_are_checked_by_bits_and_by_similarity(spark, docs_of, monkeypatch, small, slice_rows):
    rnd = random.Random(16)
    pairs = [[word(rnd) for _ in range(100)] for _ in range(12)]
    texts, prints, wanted = [], [], []
    for k, base in enumerate(pairs):
        other = base[:95] if k % 3 < 2 else [word(rnd) for _ in range(100)]
        # Similar and three bits apart; similar and four bits of one block apart; unlike and equal.
        prints += [k // 4 << 40, k // 4 << 40 ^ (0b111, 0b1111, 0)[k % 3]]
        wanted += [2 * k] + [2 * k + 1] * (k % 3 > 0)
        texts += [" ".join(base), " ".join(other)]
    hand = spark.createDataFrame(list(zip(texts, prints)), "text string, fingerprint long")
    monkeypatch.setattr(simhash, "marks", bands_of_one)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.join(hand, "text"))
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "SLICE", slice_rows)
    assert sorted(r.doc_id for r in simhash.representatives(docs_of(texts)).collect()) == wanted


def test_simhash_edges(edge_docs):
    got = simhash.near_duplicates(edge_docs)
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert got.count() == 11 and by[1] == by[6] == 1 and by[2] == by[3] == by[4] == 2
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0
    kept = simhash.representatives(edge_docs)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.select("doc_id", "text").where("doc_id < 5 or doc_id > 5 or doc_id is null").collect()) == sorted([(1, "one two three four five six"), (2, ""), (7, "short"), (8, "same id"), (8, "other text of the same id"), (-1, "no id here")])
    assert kept.columns == edge_docs.columns


# ---- lines ---------------------------------------------------------------------------------------------------------


def trimmed(line):
    return line.strip(" \t\x0b\f\r")


def brute_cuts(texts, least=50):
    """Lines to delete: of every run of ``least`` words or more that stands earlier, by comparing all places."""
    seen, kept, cuts = collections.defaultdict(list), {}, {}
    for doc in sorted(texts):
        lines = [(i, trimmed(x), len(WORDS.findall(x))) for i, x in enumerate((texts[doc] or "").split("\n")) if WORDS.search(x)]
        kept[doc], gone = lines, set()
        for p, (_, line, _) in enumerate(lines):
            for other, q in seen[line]:
                their = kept[other]
                if p and q and lines[p - 1][1] == their[q - 1][1]:
                    continue
                run = words = 0
                while p + run < len(lines) and q + run < len(their) and lines[p + run][1] == their[q + run][1] and (other != doc or q + run < p + run):
                    words += lines[p + run][2]
                    run += 1
                if words >= least:
                    gone |= {i for i, _, _ in lines[p : p + run]}
            seen[line].append((doc, p))
        cuts[doc] = gone
    return cuts


def result_cuts(df):
    out = {}
    for r in df.collect():
        lines = r.before.split("\n") if r.before is not None else []
        out[r.doc_id] = {i for c in r.removed for i in range(c.first_line, c.last_line + 1) if WORDS.search(lines[i])}
        cut = {i for c in r.removed for i in range(c.first_line, c.last_line + 1)}
        assert r.text == ("\n".join(x for i, x in enumerate(lines) if i not in cut) if r.before is not None else None)
    return out


def test_line_dedup_matches_brute_force(spark, sf_dir, docs_of):
    docs = registry.documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = linededup.dedup_lines(docs).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id")
    assert result_cuts(got) == brute_cuts(texts)
    rnd = random.Random(9)
    passages = [[sentence(rnd, rnd.choice([6, 12, 55])) for _ in range(rnd.randint(1, 6))] for _ in range(12)]
    made = []
    for _ in range(80):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            lines += rnd.choice(passages) if rnd.random() < 0.5 else [sentence(rnd, rnd.randint(1, 20)), ""]
        made.append("\n".join(lines))
    docs = docs_of(made)
    got = linededup.dedup_lines(docs).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id")
    wanted = brute_cuts(dict(enumerate(made)))
    assert result_cuts(got) == wanted and sum(map(len, wanted.values())) > 50


def test_line_dedup_sees_past_an_earlier_part_of_a_run(docs_of):
    rnd = random.Random(15)
    part, more, other = sentence(rnd, 46), sentence(rnd, 5), sentence(rnd, 46)
    lead, tail = sentence(rnd, 60), sentence(rnd, 20)
    texts = [part, other, f"{part}\n{more}", f"x\n{part}\n{more}\ny", f"{part}\n{other}", f"z\n{part}\n{other}", f"{part}\nq\n{part}\n{more}", lead, f"{lead}\n{tail}", f"u\n{lead}\n{tail}"]
    docs = docs_of(texts)
    got = linededup.dedup_lines(docs).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id")
    cuts = result_cuts(got)
    assert cuts == brute_cuts(dict(enumerate(texts))) and cuts[3] == {1, 2} and cuts[5] == {1, 2} and cuts[6] == {2, 3} and cuts[9] == {1, 2}


def test_op8_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in registry.documents(spark, sf_dir).collect()}
    cuts = brute_cuts(texts)
    for r in registry.op8_line_dedup(spark, sf_dir).collect():
        words = {i for i, x in enumerate((texts[r.doc_id] or "").split("\n")) if WORDS.search(x)}
        listed = [i for c in r.removed for i in range(c.first_line, c.last_line + 1)]
        assert r.n_removed_runs == len(r.removed) and len(listed) == len(set(listed)) and set(listed) & words == cuts[r.doc_id]
        assert all(a.last_line + 1 < b.first_line for a, b in zip(r.removed, r.removed[1:]))
        kept = None if texts[r.doc_id] is None else "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in set(listed))
        assert r.kept_chars == (None if kept is None else len(kept)) and r.kept_sha256 == (None if kept is None else hashlib.sha256(kept.encode()).hexdigest())


def test_line_windows_select_minima(docs_of):
    rnd = random.Random(21)
    block = [sentence(rnd, 10) for _ in range(12)]
    docs = docs_of(["\n".join([sentence(rnd, 10) for _ in range(40)] + block), "\n".join(block + [sentence(rnd, 10) for _ in range(40)])])
    marks = linededup.windows(linededup.lines(docs), 50)
    chosen = linededup.fingerprints(marks)
    assert chosen.count() < 104 / 2 < marks.count()
    shared = collections.Counter(r.low for r in chosen.collect())
    assert any(n == 2 for n in shared.values())
    got = linededup.dedup_lines(docs).orderBy("doc_id").collect()
    assert not got[0].removed and [tuple(c) for c in got[1].removed] == [(0, 11)]


def test_line_dedup_cuts_blank_lines_between_long_ones(docs_of):
    rnd = random.Random(22)
    a, b, c = (sentence(rnd, 60) for _ in range(3))
    got = linededup.dedup_lines(docs_of([a, f"{a}\n\n{b}", f"{a}\n\n{b}\n\n{c}", f"{b}\n\n{a}"])).orderBy("doc_id").collect()
    assert [r.text for r in got] == [a, f"\n{b}", f"\n{c}", ""]


def test_many_recurring_lines_in_one_document(docs_of):
    rnd = random.Random(23)
    known = [sentence(rnd, 50) for _ in range(200)]
    text = "\n".join(rnd.choice(known) for _ in range(32_000))
    linededup.dedup_lines(docs_of(["a b"])).collect()
    began = time.time()
    r = linededup.dedup_lines(docs_of([text])).first()
    assert time.time() - began < 15 and sorted(r.text.split("\n")) == sorted(set(text.split("\n"))) and len(r.removed) <= 200


def test_line_dedup_edges(edge_docs, docs_of):
    out = linededup.dedup_lines(edge_docs)
    assert out.count() == 11 and out.where("doc_id = 5 and size(removed) = 0").count() == 1
    assert out.where("doc_id in (3)").first().text is None
    assert linededup.dedup_lines(edge_docs.limit(0)).count() == 0
    rnd = random.Random(1)
    block = "\n".join(sentence(rnd, 30) for _ in range(3))
    got = linededup.dedup_lines(docs_of([block, "before\n" + block + "\nafter", block, f"{block}\n{block}", None])).orderBy("doc_id").collect()
    assert [r.text for r in got] == [block, "before\nafter", "", "", None] and got[1].n_chars == len("before\nafter")
    many = docs_of([block] * 400 + ["\n".join([sentence(rnd, 60)] * 300)])
    kept = linededup.dedup_lines(many).where("text <> ''").collect()
    assert len(kept) == 2 and "\n" not in kept[1].text


# ---- benchmark -----------------------------------------------------------------------------------------------------


def brute_leaks(texts, items, threshold=0.8, width=5):
    """(doc, item) to the greatest similarity of any window, and where the first such window begins."""
    cut = lambda w: [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    split = {k: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in items.items()}
    split = {k: w for k, w in split.items() if w}
    holders = collections.Counter(g for w in split.values() for g in set(cut(w)))
    foreign = 1 + math.log(max(len(split), 1))
    weight = {g: 1 + math.log(len(split) / n) for g, n in holders.items()}
    of = collections.defaultdict(set)
    for item, iw in split.items():
        for g in cut(iw):
            of[g].add(item)
    found = {}
    for doc, text in texts.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for item in {k for n in {min(width, len(x)) for x in split.values()} for i in range(len(w) - n + 1) for k in of.get(tuple(w[i : i + n]), ())}:
            iw, a = split[item], collections.Counter(cut(split[item]))
            size = min(len(iw), len(w))
            if size < min(width, len(iw)):
                continue
            for f in range(len(w) - size + 1):
                b = collections.Counter(cut(w[f : f + size]))
                if not a.keys() & b.keys():
                    continue
                shared = sum(min(a[g], b[g]) * weight[g] for g in a if g in b)
                whole = sum(n * weight[g] for g, n in a.items()) + sum(n * (weight[g] if g in a else foreign) for g, n in b.items()) - shared
                if shared / whole >= threshold - 1e-9 and shared / whole > found.get((doc, item), (0, 0))[0] + 1e-9:
                    found[doc, item] = shared / whole, f
    return found


def same_leaks(got, wanted):
    assert {(r.doc_id, r.item_id): r.first_word for r in got} == {k: f for k, (_, f) in wanted.items()} and len(got) == len(wanted)
    assert all(abs(r.similarity - wanted[r.doc_id, r.item_id][0]) < 1e-8 for r in got)


def test_op9_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in registry.documents(spark, sf_dir).collect()}
    wanted = brute_leaks(texts, {r.item_id: r.text for r in common.table(spark, sf_dir, "benchmark").collect()})
    got = registry.op9_decontamination(spark, sf_dir).collect()
    same_leaks(got, wanted)
    assert len(wanted) > 0


def test_slices_of_a_benchmark_change_nothing(spark, sf_dir):
    docs, items = registry.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark")
    whole = sorted(map(tuple, contamination.find_leaks(docs, contamination.load(items)).collect()))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    sliced = contamination.load(items, max_bytes=size // 2)
    assert sliced.slices > 1 and sorted(map(tuple, contamination.find_leaks(docs, sliced).collect())) == whole and whole


def test_altered_leaks_and_edges(spark, docs_of, edge_docs):
    rnd = random.Random(6)
    items = {i: sentence(rnd, rnd.randint(20, 60)) for i in range(40)} | {98: "three word item", 99: None}
    texts = []
    for i in range(40):
        words = items[i].split()
        if i % 2:
            words[len(words) // 2 if i % 4 == 1 else 0] = "changed"
        texts.append(sentence(rnd, 40) + "\n" + " ".join(words).upper() + " " + sentence(rnd, 40))
    texts += [sentence(rnd, 100), "holds a Three word item here"]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    bench = contamination.load(table)
    got = {(r.doc_id, r.item_id) for r in contamination.find_leaks(docs_of(texts), bench).collect()}
    wanted = brute_leaks(dict(enumerate(texts)), items)
    assert got == set(wanted) and len(got) > 25 and (41, 98) in got
    assert contamination.find_leaks(edge_docs, bench).count() == 0
    assert contamination.without_leaks(edge_docs, bench).count() == 11
    assert contamination.find_leaks(edge_docs.limit(0), bench).count() == 0
    nothing = contamination.load(table.limit(0))
    assert contamination.find_leaks(docs_of(texts), nothing).count() == 0
    with pytest.raises(ValueError):
        contamination.find_leaks(docs_of(texts), contamination.load(table, max_bytes=50))


def test_windows_with_repeated_shingles_match_brute_force(spark, docs_of):
    rnd = random.Random(26)
    pool = ["a", "b", "c"]
    items = {i: " ".join(rnd.choice(pool) for _ in range(rnd.randint(5, 14))) for i in range(30)}
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(3, 60))) for _ in range(60)]
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = contamination.find_leaks(docs_of(texts), contamination.load(table, width=3, threshold=0.6)).collect()
    wanted = brute_leaks(dict(enumerate(texts)), items, 0.6, 3)
    same_leaks(got, wanted)
    assert len(wanted) > 50


def test_leaks_just_over_the_threshold_are_all_found(spark, docs_of):
    rnd = random.Random(16)
    items = {i: sentence(rnd, 60) for i in range(120)}
    texts = []
    for i, item in items.items():
        words = item.split()
        if i < 20:
            words[0] = words[30] = "changed"
            texts.append(" ".join(words + items[i + 1].split()[:25]))
        else:
            texts.append(" ".join(words[: rnd.randint(49, 51)]))
    got = {(r.doc_id, r.item_id) for r in contamination.find_leaks(docs_of(texts), contamination.load(spark.createDataFrame(list(items.items()), "item_id long, text string"))).collect()}
    assert got == set(brute_leaks(dict(enumerate(texts)), items))
    assert len(got) > 100


# ---- pipeline ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_other_columns_and_handle_edges(spark, sf_dir, edge_docs, name, stage):
    got = stage(spark, edge_docs, sf_dir)
    empty = stage(spark, edge_docs.limit(0), sf_dir)
    assert empty.count() == 0
    if name == "tokens":
        assert got.count() == 11 and got.where("not round_trip").count() == 0
        return
    assert got.columns == edge_docs.columns == empty.columns
    rows, before = got.collect(), edge_docs.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in edge_docs.columns[5:])
    assert not collections.Counter((r.doc_id, r.text) for r in rows) - collections.Counter((r.doc_id, r.text) for r in before)
    if name == "near_duplicates":
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
        assert [k[1] for k in kept] == [1, 2, 5, 7, 8, 8, 0] and len({k[2] for k in kept}) == 7
    if name in ("line_dedup", "decontamination"):
        assert len(rows) == 11


def test_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, sf_dir))
        if name != "tokens":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "quality":
            labels = common.table(spark, sf_dir, "labels")
            assert docs.join(labels.where("quality = 0"), "doc_id", "left_semi").count() <= 3
            assert docs.join(labels.where("quality = 1"), "doc_id", "left_semi").count() >= 0.97 * labels.where("quality = 1").count()
        if name == "near_duplicates":
            sets = {r.doc_id: shingles((r.text or "").lower(), 5) for r in before.collect()}
            kept = {r.doc_id for r in docs.collect()}
            near = lambda a, b: jaccard(sets[a], sets[b]) >= 0.8
            lost = {b for b in sets if any(a < b and near(a, b) for a in sets)}
            assert all(any(a != b and near(a, b) for a in sets) for b in sets.keys() - kept)
            assert len(lost - kept) >= 0.9 * len(lost) and len(lost) > 5
    assert docs.where("not round_trip").count() == 0 and docs.count() > 100
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
