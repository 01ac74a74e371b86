"""Byte-level BPE by speculation: greedy longest matches are proposed, neighbours are checked, failures are merged.

A token sequence is what merging gives exactly when each adjacent pair is: the pair's own bytes, merged, give the
same two tokens. A pair is checked by walking both tokens' merge trees down along the seam: it fails where some merge
across the seam has a lower rank than the merges that built the parts it would join. All pairs of a batch of new words
are checked at once in numpy; only words with a failing pair are merged step by step.

Texts are cut by the byte-level pattern stated below, which the tokenizer file asks for; a special token's string is one token, as the file says. Null is
empty text. Decoding joins the tokens' bytes and reads them as UTF-8 with U+FFFD for what is not. Words are kept by
worker up to ``KEEP_WORDS``; the cache is then emptied, so memory stays bounded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brindle.llm import common

KEEP_WORDS = 800_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The file's letter of each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A tokenizer file's vocabulary and merges, with words already encoded."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        self.ids = {t: i for i, t in self.bytes_of.items()}
        size = max([*self.bytes_of, *(t["id"] for t in spec["added_tokens"])]) + 1
        self.rank, self.left, self.right = np.full(size, -1, np.int32), np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[raw(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.made.append(made := self.ids[self.bytes_of[a] + self.bytes_of[b]])
            self.pair_rank.setdefault((a, b), k)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, a, b
        keys = np.array([(a << 32) | b for a, b in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array(list(self.pair_rank.values()), np.int32)[order]
        self.single = [self.ids[bytes([x])] for x in range(256)]
        self.never = int(np.iinfo(np.int32).max)
        self.longest = max(map(len, self.ids))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.split = regex.compile(_PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.failed = self.checked = 0

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            end = min(n, at + self.longest)
            while word[at:end] not in ids:
                end -= 1
            out.append(ids[word[at:end]])
            at = end
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], self.never)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of ``a[i]`` and ``b[i]`` gives these two tokens.

        Going down the seam, the part built later (higher rank) is opened first: the seam's two parts stood side by
        side from the moment both were built until the earlier of them was merged into its parent."""
        a, b = a.copy(), b.copy()
        until = np.full(len(a), self.never, np.int64)  # rank of the merge that takes a seam part away; ties: leftmost merge first
        until_is_left = np.zeros(len(a), bool)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            cross = self.merge_rank(x, y)
            # The crossing merge happens if it comes before the merge that consumes a part. At equal rank the left one comes first:
            # a left part is consumed by a merge further left, so it wins; a right part's merge is further right, so it loses.
            bad = (cross < until[live]) | ((cross == until[live]) & (cross != self.never) & ~until_is_left[live])
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            open_left = rx >= ry  # equal ranks: the same merge done left to right, so the right one was made later
            open_left &= rx != ry
            until[live] = np.where(open_left, rx, ry)
            until_is_left[live] = open_left
            a[live] = np.where(open_left, self.right[x], x)
            b[live] = np.where(open_left, y, self.left[y])
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merging step by step: the lowest rank first, of equal ones the leftmost."""
        parts, rank_of, made, never = [self.single[x] for x in word], self.pair_rank.get, self.made, self.never
        if len(parts) > 200:
            return self.exact_long(parts)
        ranks = [rank_of(p, never) for p in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            i = ranks.index(rank)
            parts[i : i + 2] = [made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), never)
        return parts

    def exact_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over linked parts, for words of any length."""
        n, rank_of, made = len(parts), self.pair_rank.get, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank_of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank_of(p := (parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, p))
        return [p for p in parts if p >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not kept yet."""
        if len(self.words) + len(words) > KEEP_WORDS:
            self.words.clear()
        raw = [w.encode() for w in words]
        proposed = [self.greedy(w) for w in raw]
        length = np.array([len(p) for p in proposed])
        flat = np.array([t for p in proposed for t in p], np.int32)
        owner = np.repeat(np.arange(len(words)), length)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        code, back = np.unique((flat[pair].astype(np.int64) << 32) | flat[pair + 1], return_inverse=True)
        good = self.compatible((code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32))[back]
        for k in np.unique(owner[pair[~good]]):
            proposed[k] = self.exact(raw[k])
            self.failed += 1
        self.checked += len(words)
        for w, p in zip(words, proposed):
            self.words[w] = np.array(p, "<u4").tobytes()

    def cut(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if not any(s in text for s in self.specials):
            return self.split(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self.split(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cuts = [self.cut(t) for t in texts]
        new: set[str] = set()
        for c in cuts:
            new.update(c)
        if self.specials:
            new = {w for w in new if isinstance(w, str)}
        if len(self.words) + len(new) > KEEP_WORDS:
            self.words.clear()
        new -= self.words.keys()
        if new:
            self.learn(list(new))
        known = self.words.__getitem__
        for i in self.specials.values():
            self.words[i] = np.array([i], "<u4").tobytes()
        return [b"".join(map(known, c)) for c in cuts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _ready(spec: str) -> Bpe:
    return Bpe(json.loads(spec))


def load(path: str) -> str:
    """The text of a tokenizer file of bounded size, read where the job is planned so that executors need no file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, *, text: str = "text", with_decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and, if asked, ``decoded``, the text made of them again."""
    docs = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = common.extended(docs.schema, ids="binary", **({"decoded": "string"} if with_decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(shared.value)
        for part in common.pieces(batches, text, 1 << 20):
            ids = bpe.encode_batch([t or "" for t in part.column(text).to_pylist()])
            out = part.append_column("ids", pa.array(ids, pa.binary()))
            if with_decoded:
                out = out.append_column("decoded", pa.array([bpe.decode(i) for i in ids], pa.string()))
            yield out

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, spec: str) -> DataFrame:
    """Per document the number of ids, their digest and that of the decoded text; the texts stay in the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(shared.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in common.pieces(batches, "text", 1 << 20):
            ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(sha, ids)), pa.array([sha(bpe.decode(i).encode()) for i in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
