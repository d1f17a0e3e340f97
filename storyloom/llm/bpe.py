"""Byte-pair encoding by speculation and verification, and decoding.

A word's encoding is first guessed: the longest token that fits, again and again. The guess is the
true encoding if and only if every two neighbours in it are compatible: encoding their joined bytes
gives the two tokens back. Compatibility is decided for all new pairs of a batch at once: along the
boundary, the right edge of the left token and the left edge of the right token grow with the
merges that made them, and a pair is incompatible if a merge across the boundary comes first. Only
words with an incompatible pair are merged exactly. Words are remembered, so a word costs once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# Fixed value: the public byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of memory that the words a worker remembers take, about; beyond it, it starts anew. A longer word is never remembered.
REMEMBERED, LONGEST = 256 << 20, 64
#: Texts whose words are guessed and verified together, and their characters: fewer texts where they are long.
TOGETHER, CHARS = 128, 1 << 20
#: Words of one longer text that are encoded at once.
WORDS = 1 << 16
#: Up to so many bytes, a word is merged without a heap.
SHORT = 48
NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def _room(word: str, ids) -> int:
    """Bytes of a word, its ids and their places in a dictionary and a set, about."""
    return 240 + 2 * len(word) + 8 * len(ids)


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        to_bytes = lambda s: bytes(letter[c] for c in s)
        vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in letter for c in k)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for k, v in vocab.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode("utf-8")
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        made_by: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[to_bytes(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            to = vocab[self.bytes_of[a] + self.bytes_of[b]]
            self.merge.setdefault((a, b), (rank, to))
            made_by.setdefault(to, (rank, a, b))
        codes = sorted((a * self.size + b, r) for (a, b), (r, _) in self.merge.items())
        self.codes = np.array([c for c, _ in codes] or [-1], np.int64)
        self.code_rank = np.array([r for _, r in codes] or [NEVER], np.int32)
        self.rank = np.full(self.size, -1, np.int32)
        for t, (r, _, _) in made_by.items():
            self.rank[t] = r
        self.right, self.left = self._edges(made_by, 2), self._edges(made_by, 1)
        self.guessable = self._guessable(vocab, made_by)
        #: The longest token that starts with these three bytes.
        self.reach: dict[bytes, int] = {}
        for k in self.guessable:
            if len(k) > 2:
                self.reach[k[:3]] = max(len(k), self.reach.get(k[:3], 0))
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        #: Bytes that the known words take, about; those of them that have come again; those that are too long to stay.
        self.held, self.again, self.passing = 0, set(), []
        self.compatible: dict[int, bool] = {}
        self.merged_exactly = 0

    def _edges(self, made_by: dict, side: int) -> np.ndarray:
        """For each token, the tokens that stand at its edge as it grows, from a byte to the token itself, then itself again."""
        edges = []
        for t in range(self.size):
            e = [t]
            while e[-1] in made_by:
                e.append(made_by[e[-1]][side])
            edges.append(e[::-1])
        out = np.zeros((self.size, max(map(len, edges)) + 1), np.int32)
        for t, e in enumerate(edges):
            out[t] = e + [t] * (out.shape[1] - len(e))
        return out

    def _crossed(self, a: np.ndarray, b: np.ndarray, at_the_top: bool) -> np.ndarray:
        """Whether a merge across the boundary of a and b comes before both are whole (or, if wanted, after)."""
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        crossed, open_ = np.zeros(len(a), bool), np.arange(len(a))
        while open_.size:
            ao, bo = a[open_], b[open_]
            x, y = self.right[ao, i[open_]], self.left[bo, j[open_]]
            a_up, b_up = self.right[ao, i[open_] + 1], self.left[bo, j[open_] + 1]
            a_next = np.where(x == ao, NEVER, self.rank[a_up])
            b_next = np.where(y == bo, NEVER, self.rank[b_up])
            code = x.astype(np.int64) * self.size + y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            m = np.where(self.codes[at] == code, self.code_rank[at], NEVER)
            top = (a_next == NEVER) & (b_next == NEVER)
            # a merge of the left token stands further left, so it wins a tie; the right token's loses it
            hit = (m != NEVER) & (m < a_next) & (m <= b_next) & (at_the_top | ~top)
            crossed[open_[hit]] = True
            a_first = a_next <= b_next
            i[open_] += a_first & ~top
            j[open_] += ~a_first & ~top
            open_ = open_[~hit & ~top]
        return crossed

    def _guessable(self, vocab: dict[bytes, int], made_by: dict) -> dict[bytes, int]:
        """Tokens that their own bytes encode to; no other token can stand in an encoding."""
        order = sorted(made_by, key=lambda t: made_by[t][0])
        a, b = (np.array([made_by[t][k] for t in order], np.int64) for k in (1, 2))
        sound = {t: True for t in self.byte_id}
        for t, bad in zip(order, self._crossed(a, b, False) if order else []):
            sound[t] = not bad and sound.get(made_by[t][1], False) and sound.get(made_by[t][2], False)
        return {k: v for k, v in vocab.items() if sound.get(v, False)}

    def guess(self, word: bytes) -> list[int]:
        """Longest token first, from the left."""
        out, i, n, token, reach = [], 0, len(word), self.guessable.get, self.reach.get
        while i < n:
            j = min(n, i + reach(word[i : i + 3], 2))
            while (t := token(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges in order of rank, leftmost first, with a heap."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            return self._exact_short(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        merge = self.merge
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            nxt = after[k]
            if not live[k] or ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], live[nxt], after[k] = to, False, after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if m := merge.get((to, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, to, ids[after[k]], m[1]))
            if before[k] >= 0 and (m := merge.get((ids[before[k]], to))):
                heapq.heappush(heap, (m[0], before[k], ids[before[k]], to, m[1]))
        return [t for t, on in zip(ids, live) if on]

    def _exact_short(self, ids: list[int]) -> list[int]:
        """The same without a heap: ranks of all neighbours in a list, of which the least is taken."""
        merge = self.merge
        none = (int(NEVER), 0)
        pairs = [merge.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            k = pairs.index(best)
            ids[k : k + 2] = (best[1],)
            del pairs[k]
            if k < len(pairs):
                pairs[k] = merge.get((ids[k], ids[k + 1]), none)
            if k:
                pairs[k - 1] = merge.get((ids[k - 1], ids[k]), none)
        return ids

    def learn(self, words: set[str]) -> None:
        """Encode words not known yet: guess, verify all pairs together, merge exactly those that fail."""
        for w in self.passing:
            self.known.pop(w, None)
        self.passing = []
        if self.held > REMEMBERED:
            # words that have come again stay, unless they alone fill most of the room
            self.known = {w: self.known[w] for w in self.again if w in self.known}
            self.held, self.again = sum(map(_room, self.known, self.known.values())), set()
            if self.held > REMEMBERED * 3 // 4:
                self.known, self.held = {}, 0
        new = [w for w in words if w not in self.known]
        self.again.update(words.difference(new) if len(new) < len(words) else ())
        if not new:
            return
        raw = [w.encode("utf-8") for w in new]
        guesses = [self.guess(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(sizes) - 1] = False  # a word's last token has no right neighbour
        at = np.flatnonzero(inner)
        codes, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = self._crossed(codes // self.size, codes % self.size, True)[back]
        word_of = np.repeat(np.arange(len(new)), sizes)[at]
        for k in np.unique(word_of[bad]).tolist():
            guesses[k] = self.exact(raw[k])
            self.merged_exactly += 1
        self.known.update(zip(new, map(tuple, guesses)))
        self.passing = [w for w in new if len(w) > LONGEST]
        self.held += sum(_room(w, g) for w, g in zip(new, guesses) if len(w) <= LONGEST)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each whole text; null counts as empty, special tokens in a text are found as such."""
        out, i = [], 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j] or "") <= CHARS):
                total += len(texts[j] or "")
                j += 1
            out += self._encode(texts[i:j]) if total <= CHARS else [self._encode_long(texts[i])]
            i = j
        return out

    def _parts(self, text: str | None) -> list[str]:
        """The text cut at special tokens, which are at odd places."""
        return self.parts.split(text) if text and self.parts and self.parts.search(text) else [text or ""]

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [[[self.special[p]] if k % 2 else self.words.findall(p) for k, p in enumerate(self._parts(t))] for t in texts]
        self.learn({w for parts in split for ws in parts[::2] for w in ws})
        known = self.known
        return [
            np.fromiter(chain.from_iterable(chain.from_iterable(map(known.__getitem__, ws)) if not k % 2 else ws for k, ws in enumerate(parts)), np.int32)
            for parts in split
        ]

    def _encode_long(self, text: str) -> np.ndarray:
        """One text, some words at a time."""
        ids = [np.zeros(0, np.int32)]
        for k, part in enumerate(self._parts(text)):
            if k % 2:
                ids.append(np.array([self.special[part]], np.int32))
                continue
            found = self.words.finditer(part)
            while words := [m[0] for m in islice(found, WORDS)]:
                self.learn(set(words))
                ids.append(np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32))
        return np.concatenate(ids)

    def forget(self) -> None:
        """Drops the words, so that an idle worker holds none."""
        self.known, self.held, self.again, self.passing = {}, 0, set(), []

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters, ids without a token nothing."""
        table, size = self.bytes_of, self.size
        return b"".join([table[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Bpe:
    return Bpe(path)


def coded(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """``keep`` and ``(ids array<int>, n_tokens, decoded string)``: each row's whole text encoded, and the ids decoded.

    ``vocabulary`` is the path of a byte-level vocabulary file that all machines have. A null text
    counts as empty: no ids, empty decoded text. Repeated rows are coded each; columns that aren't kept are
    ignored; an empty table gives an empty result. Memory is a few texts at a time. Without
    ``decode`` there is no column ``decoded``.
    """
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    made = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded", StringType())]
    schema = StructType([*rows.schema.fields[:-1], *(made if decode else made[:-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                ids = bpe.encode_batch(part.column(part.num_columns - 1).to_pylist())
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
                columns = [*part.columns[:-1], lists, pa.array(sizes)]
                if decode:
                    columns.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        bpe.forget()  # other stages may use the worker next

    return rows.mapInArrow(run, schema)


def coding_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``coded``, digested where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for i in range(0, batch.num_rows, TOGETHER):
                for ids in map(np.ndarray.tolist, bpe.encode_batch(batch.column(1).slice(i, TOGETHER).to_pylist())):
                    n.append(len(ids))
                    of_ids.append(hexed(",".join(map(str, ids)).encode()))
                    of_text.append(hexed(bpe.decode(ids).encode("utf-8")))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
