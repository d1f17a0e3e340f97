"""Packing of token sequences into as few sequences of one length as best fit can find.

Texts are tokenised and cut into pieces no longer than a sequence. Pieces are range-sorted by length and get their rank within it, and so do the gaps of
sequences: as lengths are whole numbers up to the capacity, pieces of one length are one run of ranks, gaps of one size likewise, and the sorted tables are
at most ``capacity`` runs each, however many rows they stand for. Supersteps go over these runs: the longest pieces that must have sequences of their own open them; then in each sweep
every run of pieces, from the longest down, meets the smallest gaps that hold it, ranks tell which piece gets which gap where both want it, and a gap that
took pieces comes back smaller in the next sweep. Sweeps repeat until no gap holds any piece, and again after opening no more sequences than the pieces that are left need
at least. The matches, runs of ranks on both sides, are broadcast, and each piece looks up its sequence and offset by its rank, where it stands.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from storyloom.functions.session import checkpointed
from storyloom.llm.arrow import rows_of
from storyloom.llm.bpe import byte_letters
from storyloom.llm.ranks import ranked

#: Characters that are split into runs at a time, and bytes of remembered runs in a worker.
BLOCK, REMEMBERED = 1 << 21, 256 << 20
#: The settings of the vocabulary whose texts are encoded word by word, and its runs in lower-case text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"
#: Spaces, line ends and words of printable ASCII and of the letters of Latin-1 with marks, whose classes and lower cases never differ.
PLAIN = re.compile(r"[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
#: The letter that stands for each byte but a space's; printable ASCII stands for itself.
LETTERS = {b: letter for letter, b in byte_letters().items() if b != 32}
#: Kinds of bytes of lower-case plain text. All bytes that aren't ASCII are of letters, and so is the one that begins the mark of a word that isn't plain.
SPACE, LETTER, DIGIT, OTHER = range(4)
MARK, NUMBERS = "\x01", str.maketrans("0123456789", "abcdefghij")
KIND = np.full(256, OTHER, np.uint8)
KIND[[*b" \n"]], KIND[[*b"0123456789"]], KIND[[*b"abcdefghijklmnopqrstuvwxyz\x01", *range(128, 256)]] = SPACE, DIGIT, LETTER
RANK_BITS = 44
SHARES = (1.0, 0.5, 0.25, 0.125)


class Words:
    """Ids of texts, equal to the library's.

    Where the vocabulary drops white space, nothing that the library does reaches over a space or a line end. Words of letters that lower-case one by one are put in lower case and cut into the runs that the
    library would cut them into, for all words of a block at once: by the kinds of neighbouring bytes. Arrow finds the runs that differ, and these alone are looked up among the remembered ones.
    New runs go to the library's model, in the letters that stand for their bytes. Any other word stands in the block as a mark and goes to the library whole. With a vocabulary of another kind whole texts do.
    """

    def __init__(self, vocabulary: str, most: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        self.merged = self.library.model.tokenize
        self.by_word = (made["normalizer"], made["pre_tokenizer"], made["post_processor"], made["model"].get("end_of_word_suffix")) == (NORMALIZER, PRE_TOKENIZER, None, WORD_END)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or "(?!)")
        self.most, self.size = most, 0
        #: Runs, a letter for each byte of theirs, and words that aren't plain, behind the byte of marks.
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: Iterable[str]) -> list[bytes]:
        return [array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    def _learn(self, unknown: list[str]) -> Iterator[bytes]:
        """Remembers the runs and words; those of the generation before this one come over. Tells their ids."""
        words, old = self.words, self.old
        new = [w for w in unknown if w not in old]
        words.update((w, old[w]) for w in unknown if w in old)
        odd = [w for w in new if w[0] == MARK]
        words.update(zip(odd, self._whole(w[1:] for w in odd), strict=True))
        runs = [w for w in new if w[0] != MARK] if odd else new
        text, merged = " ".join(runs), self.merged
        letters = (text if text.isascii() else text.translate(LETTERS)).split(" ") if runs else []
        words.update((r, array("I", [t.id for t in merged(x)]).tobytes()) for r, x in zip(runs, letters, strict=True))
        found = list(map(words.__getitem__, unknown))
        # two objects and a place in a dictionary, about; words that aren't plain may take four bytes a letter
        self.size += 160 * len(unknown) + (4 if odd else 1) * sum(map(len, unknown)) + sum(map(len, found))
        return iter(found)

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of runs and words that differ. What none asked for in a generation is forgotten with it."""
        if 2 * self.size > self.most:
            self.old, self.words, self.size = self.words, {}, 0
        found = list(map(self.words.get, words))
        unknown = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if unknown:
            new = self._learn(unknown)
            found = [next(new) if ids is None else ids for ids in found]
        return found

    def _plain(self, block: str, odd: dict[str, str]) -> str:
        """The block in lower case; marks stand for the words that aren't plain and are remembered in ``odd``."""
        if not PLAIN(block) or self.special.search(block):
            cut = block.replace("\n", " ").split(" ")
            for w in set(cut).difference(odd):
                if not PLAIN(w) or self.special.search(w):
                    odd[w] = MARK + str(len(odd)).translate(NUMBERS)
            block = " ".join(map(odd.get, cut, cut))
        return block.lower()

    def _encoded(self, blocks: list[str]) -> list[bytes]:
        """The ids of each block."""
        odd: dict[str, str] = {}
        parts = [self._plain(b, odd).encode() for b in blocks]
        raw = np.frombuffer(b" ".join([*parts, b"  "]), np.uint8)
        first, held = _cut(raw)
        starts = np.flatnonzero(first & held)
        if not starts.size:
            return [b""] * len(blocks)
        data = raw[held]
        places = np.append(np.flatnonzero(first[held]), len(data))
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        _, at, body = runs.dictionary.buffers()
        at, text = np.frombuffer(at, np.int64, len(runs.dictionary) + 1).tolist(), str(body, "latin-1")
        words = [text[i:j] for i, j in pairwise(at)]
        if odd:
            marked = {mark: MARK + w for w, mark in odd.items()}
            words = list(map(marked.get, words, words))
        made = pa.array(self._ids(words), pa.large_binary()).take(runs.indices)
        _, at, body = made.buffers()
        ends = np.cumsum([len(p) + 1 for p in parts])
        bounds = np.frombuffer(at, np.int64, len(made) + 1)[np.append(0, np.searchsorted(starts, ends))].tolist()
        body = memoryview(body or b"")
        return [body[i:j].tobytes() for i, j in pairwise(bounds)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self._whole(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        for group in _groups((k, block) for k, text in enumerate(texts) for block in _blocks(text)):
            for (k, _), found in zip(group, self._encoded([block for _, block in group]), strict=True):
                out[k].append(found)
        return [b"".join(found) for found in out]


@lru_cache(maxsize=1)
def words_of(vocabulary: str) -> Words:
    """The worker's words, which outlive a task: tasks know this function by its name, while they get copies of the values that they refer to."""
    return Words(vocabulary)


def _cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of lower-case plain text begin, and which bytes are no spaces.

    Runs are what follows an apostrophe in English and the apostrophe, else letters, a digit, or other characters, as in the vocabulary's pattern. An apostrophe inside a run of other characters belongs to it.
    ``raw`` ends with two spaces.
    """
    kind = KIND[raw]
    first = kind == DIGIT
    first[0] = True
    first[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(raw == ord("'"))
    at = at[first[at]]
    after = raw[at + 1]
    one = np.isin(after, [*b"stmd"])
    pair = after.astype(np.uint16) << 8 | raw[np.minimum(at + 2, len(raw) - 1)]
    two = np.isin(pair, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
    first[at[one | two] + 1] = False
    first[at[one] + 2] = True
    first[at[two] + 3] = True
    return first, kind != SPACE


def _groups(blocks: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Blocks, about ``BLOCK`` characters at a time."""
    group, n = [], 0
    for k, block in blocks:
        group.append((k, block))
        n += len(block)
        if n >= BLOCK:
            yield group
            group, n = [], 0
    if group:
        yield group


def _blocks(text: str) -> Iterator[str]:
    """The text in blocks of about ``BLOCK`` characters that end before a space."""
    at = 0
    while len(text) - at > BLOCK:
        end = text.find(" ", at + BLOCK)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def coded(words: Words, column: pa.Array) -> Iterator[bytes]:
    """The ids of a column's texts, which are held as Python objects about ``BLOCK`` characters at a time."""
    held, size = [], 0
    for text in rows_of(column, 64):
        held.append(text or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield from words.ids(held)
            held, size = [], 0
    yield from words.ids(held) if held else ()


def tokenised(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and ``end_id``, cut into pieces of ``capacity``; written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    arrow, last = to_arrow_schema(StructType.fromDDL(schema)), np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        for batch in batches:
            place, pieces, starts, lengths, sums = [], [], [], [], []
            for row, found in enumerate(coded(words, batch.column(1))):
                ids = found + last
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[i : i + 4 * capacity]
                    place.append(row)
                    pieces.append(k)
                    starts.append(i // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, f.type) for c, f in zip((pieces, starts, lengths, sums), list(arrow)[1:], strict=True))], schema=arrow)

    return checkpointed(docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(task, schema))


class Supersteps:
    """Best fit of runs of pieces into runs of gaps.

    ``matches`` are ``(length, rank, count, each, sequence, offset)``: ``count`` pieces of a length from a rank on go to sequences from ``sequence`` on, ``each`` to
    one, the first at ``offset``. Their number depends on the lengths that occur and hardly on how many pieces there are.
    """

    def __init__(self, counts: dict[int, int], capacity: int, share: float = 1.0):
        self.capacity, self.share, self.left = capacity, share, dict(counts)
        self.taken: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sequences = 0
        self.matches: list[tuple[int, int, int, int, int, int]] = []
        while self.left:
            self._open()
            while self._sweep():
                pass

    def _place(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.matches.append((length, self.taken[length], count, each, sequence, offset))
        self.taken[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _open(self) -> None:
        """The longest pieces open sequences: all of more than half the capacity, and a share of as many as the tokens that are left fill at least."""
        tokens = sum(length * n for length, n in self.left.items())
        most = max(1, int(tokens // self.capacity * self.share), sum(n for length, n in self.left.items() if 2 * length > self.capacity))
        self.gaps = defaultdict(list)
        for length in sorted(self.left, reverse=True):
            n = min(most, self.left[length])
            if not n:
                break
            self._place(length, n, 1, self.sequences, 0)
            if length < self.capacity:
                self.gaps[self.capacity - length].append((self.sequences, n))
            self.sequences += n
            most -= n

    def _sweep(self) -> bool:
        """Every gap takes pieces of one length at most; the smallest gap that holds a run of pieces comes first. Tells if any did."""
        sizes, waiting, after = sorted(self.gaps), [], defaultdict(list)
        before = len(self.matches)
        for length in sorted(self.left, reverse=True):
            while sizes and sizes[-1] >= length:
                size = sizes.pop()
                waiting += [(size, *run) for run in self.gaps[size]]
            while waiting and length in self.left:
                size, first, n = waiting.pop()
                each = min(size // length, self.left[length])
                full = min(n, self.left[length] // each)
                if full < n:
                    waiting.append((size, first + full, n - full))
                self._place(length, full * each, each, first, self.capacity - size)
                if size > each * length:
                    after[size - each * length].append((first, full))
        least = min(self.left, default=self.capacity + 1)
        for size, *run in waiting:
            if size >= least:
                after[size].append(tuple(run))
        self.gaps = {size: runs for size, runs in after.items() if size >= least}
        return len(self.matches) > before


def fewest(counts: dict[int, int], capacity: int) -> Supersteps:
    """Of a few shares of sequences to open at a time the one that needs the fewest sequences."""
    return min((Supersteps(counts, capacity, share) for share in SHARES), key=lambda s: s.sequences)


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row of ``docs(doc_id, text, ...)``.

    A null text counts as empty: its only id is the one that ends a document. Of texts longer than ``capacity`` every piece but the last fills a sequence. Rows that repeat, or
    share a doc_id, are packed each. An empty table gives an empty result; other columns are ignored.
    """
    pieces, sizes = ranked(tokenised(docs, vocabulary, capacity), "length", ["doc_id", "piece", "ids_crc32"])
    counts = {r.length: r.total for r in sizes.collect()}  # at most ``capacity`` rows
    table = match_table(fewest(counts, capacity).matches)
    known = docs.sparkSession.sparkContext.broadcast(table)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = placed(known.value, length, rank)
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return pieces.select(*kept, "rank").mapInArrow(task, schema)


def match_table(matches: Iterable[tuple[int, int, int, int, int, int]]) -> np.ndarray:
    """Matches in order of length and rank, a column each; the first column holds both."""
    t = np.array(sorted(matches), np.int64).reshape(-1, 6)
    return np.column_stack([t[:, 0] << RANK_BITS | t[:, 1], t])


def placed(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank."""
    m = table[np.searchsorted(table[:, 0], length << RANK_BITS | rank, side="right") - 1]
    sequence, turn = np.divmod(rank - m[:, 2], m[:, 4])
    return m[:, 5] + sequence, m[:, 6] + turn * length
