"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams, in order. A document's own list is
compared with each profile by out-of-place distance: the sum over its n-grams of the difference in rank, or the
profile's length where the profile doesn't have the n-gram. The language of least distance wins.

Text is read as runs of lower-cased letters; an n-gram is one to three symbols of ``_run_``, where ``_`` marks
the run's ends. Letters are numbered by frequency in the training sample; rarer letters share one
number. An n-gram is a number then, and n-grams of many whole documents are counted by one sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: n-grams of a profile and of a document's list.
LENGTH = 300
#: Numbered letters; 0 is no n-gram, 1 a run's end, 2 a rarer letter.
LETTERS = 250
#: Bound of the training sample: rows of each language, and bytes of a row.
TRAIN_ROWS, TRAIN_BYTES = 400, 32768
#: Rows of a language that has longer ones only.
LONG_ROWS = 4
#: Characters whose n-grams are counted by one sort; a longer document is counted in pieces.
AT_ONCE = 1 << 18
CODE_BITS, COUNT_BITS = 24, 26


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 and low.isalpha() else c
    return table


def letters_of(text: str) -> np.ndarray:
    """The text's code points as lower-case letters, with 0 between runs and at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 2, np.uint32)
    out[1:-1] = letter_table()[points]
    return out


def grams_of(symbols: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of one to three symbols (8 bits each) in runs ended by 1; none reaches over a run's end."""
    s = symbols.astype(np.int64)
    two = (s[:-1] << 8) | s[1:]
    inner = s[1:-1] != 1
    return np.concatenate([s[s != 1], two[(s[:-1] != 1) | (s[1:] != 1)], ((two[:-1] << 8) | s[2:])[inner]])


def _ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, equal counts by number."""
    return codes[np.lexsort((codes, -counts))[:most]]


def _pieces(grams: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(grams), 8 * AT_ONCE):
        yield grams[i : i + 8 * AT_ONCE]


def _counted(pieces: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and how often they occur, gathered a few pieces at a time."""
    codes, counts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for piece in chain(pieces, [None]):
        if piece is not None:
            held.append(piece)
        if held and (piece is None or sum(map(len, held)) >= 8 * AT_ONCE):
            c, n = np.unique(np.concatenate(held), return_counts=True)
            codes, back = np.unique(np.concatenate([codes, c]), return_inverse=True)
            counts, held = np.bincount(back, np.concatenate([counts, n])).astype(np.int64), []
    return codes, counts


@dataclass
class Profiles:
    languages: list[str]
    #: Code point -> symbol.
    alphabet: dict[int, int]
    #: All n-grams of any profile in order, and for each language the rank of each, LENGTH where it has none.
    codes: np.ndarray
    ranks: np.ndarray

    def _symbols(self, table: np.ndarray, text: str) -> np.ndarray:
        return table[letters_of(text)]

    def table(self) -> np.ndarray:
        out = np.full(0x110000, 2, np.uint8)
        out[0] = 1
        for c, s in self.alphabet.items():
            out[c] = s
        return out

    def lists(self, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its most frequent n-grams: text number, rank and n-gram."""
        parts = [grams_of(self._symbols(table, t)) for t in texts]
        if len(parts) == 1:  # may be very long: its n-grams are counted piece by piece
            top = _ranked(*_counted(_pieces(parts[0])), LENGTH)
            return np.zeros(len(top), np.int64), np.arange(len(top)), top
        sizes = np.array([len(p) for p in parts])
        both = np.concatenate(parts) | (np.repeat(np.arange(len(texts)), sizes) << CODE_BITS)
        both.sort()
        start = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        counts, both = np.diff(np.append(start, len(both))), both[start]
        # text, falling count and n-gram in one number, so that a plain sort ranks all lists
        order = ((both >> CODE_BITS) << (COUNT_BITS + CODE_BITS)) | (((1 << COUNT_BITS) - 1 - counts) << CODE_BITS) | (both & ((1 << CODE_BITS) - 1))
        order.sort()
        doc = order >> (COUNT_BITS + CODE_BITS)
        first = np.searchsorted(doc, np.arange(len(texts)))
        rank = np.arange(len(doc)) - first[doc]
        keep = rank < LENGTH
        return doc[keep], rank[keep], order[keep] & ((1 << CODE_BITS) - 1)

    def distances(self, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each language, and the size of each text's list."""
        doc, rank, code = self.lists(table, texts)
        size = np.bincount(doc, minlength=len(texts))
        if not len(self.codes):
            return np.zeros((len(texts), len(self.languages))), size
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        there = self.codes[at] == code
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            theirs = self.ranks[k][at]
            away = np.where(there & (theirs < LENGTH), np.abs(theirs - rank), LENGTH)
            out[:, k] = np.bincount(doc, away, len(texts))
        return out, size

    def predict(self, table: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is how much nearer the best profile is than the next, from 0 to 1."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j] or "") <= AT_ONCE):
                total += len(texts[j] or "")
                j += 1
            far, size = self.distances(table, [t or "" for t in texts[i:j]])
            for k in np.flatnonzero(size).tolist():
                if self.languages:
                    order = np.argsort(far[k], kind="stable")
                    names[i + k] = self.languages[order[0]]
                    best, next_ = far[k][order[0]], far[k][order[1]] if len(order) > 1 else size[k] * LENGTH
                    scores[i + k] = 1 - best / next_ if next_ else 0.0
            i = j
        return names, np.clip(scores, 0, 1)


def profiles(samples: list[tuple[str, str]]) -> Profiles:
    """Profiles of ``(language, text)`` rows."""
    seen, counts = np.unique(np.concatenate([letters_of(t) for _, t in samples] or [np.zeros(0, np.uint32)]), return_counts=True)
    order = [c for c in seen[np.lexsort((seen, -counts))].tolist() if c][:LETTERS]
    out = Profiles(sorted({lang for lang, _ in samples}), {c: 3 + i for i, c in enumerate(order)}, np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
    table, tops = out.table(), []
    for lang in out.languages:
        tops.append(_ranked(*_counted(piece for of, t in samples if of == lang for piece in _pieces(grams_of(out._symbols(table, t)))), LENGTH))
    if tops:
        out.codes = np.unique(np.concatenate(tops))
        out.ranks = np.full((len(tops), len(out.codes)), LENGTH, np.int64)
        for k, top in enumerate(tops):
            out.ranks[k][np.searchsorted(out.codes, top)] = np.arange(len(top))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learned(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, long_rows: int = LONG_ROWS) -> Profiles:
    """Profiles learned from ``docs(doc_id, lang, text, ...)``: rows with a language and a text that aren't held out.

    The sample is bounded: of each language the ``rows`` different rows of least hash (of doc_id and text) among those of at most
    ``most_bytes`` bytes; of a language all of whose rows are longer its ``long_rows`` shortest ones, whole. Rows that repeat count once, rows that share a doc_id only count each. Different rows are
    counted first, by a sketch, and only a stretch of the hash range that holds twice as many as wanted is ranked, so a frequent language moves no more than a rare one. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mark = F.xxhash64("doc_id", "text")
    sized = known.select("doc_id", "lang", mark.alias("h"), F.octet_length("text").alias("bytes"))
    short = F.col("bytes") <= most_bytes
    # one row for each language
    counts = {r["lang"]: r["n"] for r in sized.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("h"))).alias("n")).toLocalIterator()}
    if not counts:
        return profiles([])
    # a share of the hash range that holds twice the rows wanted, and 100 more; of these the least are taken
    edge = lambda n: -(1 << 63) + min((1 << 64) - 1, (2 * rows + 100) * (1 << 64) // n)
    edges = F.create_map(*(x for lang, n in counts.items() if n for x in (F.lit(lang), F.lit(edge(n)))), *((F.lit(""), F.lit(0).cast("long")) if not any(counts.values()) else ()))
    row = ["doc_id", "lang", "h", "bytes"]
    near = sized.where(short & (F.col("h") <= F.try_element_at(edges, F.col("lang")))).select(*row).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = near.withColumn("place", place).where(F.col("place") <= rows).select(*row)
    if any(n == 0 for n in counts.values()):
        by_size = F.row_number().over(Window.partitionBy("lang").orderBy("bytes", "h", "doc_id"))
        long = sized.where(F.col("lang").isin([lang for lang, n in counts.items() if not n])).select(*row).distinct().withColumn("place", by_size)
        picked = picked.union(long.where(F.col("place") <= long_rows).select(*row))
    picked = picked.select(*(F.col(c).alias(f"of_{c}") for c in row))
    # at most ``rows`` rows for each language, and of rows that repeat one
    same = (F.col("doc_id") == F.col("of_doc_id")) & (F.col("lang") == F.col("of_lang")) & (F.octet_length("text") == F.col("of_bytes")) & (mark == F.col("of_h"))
    sample = docs.join(F.broadcast(picked), same).groupBy("doc_id", "lang", "of_h").agg(F.first("text").alias("text"))
    return profiles(sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").toLocalIterator()))


def identified(docs: DataFrame, known: Profiles) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row, from its whole text alone.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Equal distances go to the
    first language in order. Repeated rows get equal results, other columns are ignored, an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.table()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, scores = known.predict(table, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
