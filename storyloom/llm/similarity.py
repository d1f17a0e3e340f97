"""Near duplicates by exact Jaccard similarity of word shingles: a set join with a prefix filter.

1. Each text is the set of its distinct word shingles, as 64-bit numbers. Equal sets are one class.
2. The shingles of a bounded sample of rows are counted. A set's shingles are ordered by that count, then by number; any order that
   all sets share gives right results, this one puts what many texts quote last. What still is frequent among the first shingles of every sixteenth
   set (a passage that a thousandth of all texts share is missed by a small sample) goes last too, and sets that have such among their first ones
   are ordered anew.
3. Two sets of similarity t or more share n shingles among the first ``size - ceil(t * size) + n`` of each, where n grows with the smaller
   set. Of a shingle that few sets have there, all pairs of fitting sizes are counted; one that many have links its
   sets to the least of them, so the rows don't grow with the square of a group. Pairs that share enough, and these links,
   are candidates; the components of that graph are a superset of those wanted.
4. Whole sets meet by candidate component. Pairs that share a shingle of their prefixes are compared by their whole sets, but for those
   that verified links already join. A large component is first compared with a few of its sets, its pivots, slice by slice; the sets
   similar to one pivot are joined through it, and only what is left is compared with all of the component, in pairs of blocks. A group of
   copies costs in proportion to its size so, and no pair is left out.
5. Connected components over the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed, compacted
from storyloom.llm.arrow import rows_of, whole_groups
from storyloom.operators.components import connected_components

#: Rows whose shingles are counted, and counted shingles that are sent to all workers. They bear on speed, not on results.
SAMPLE_ROWS, COUNTED, LEAST_COUNT = 8_000, 100_000, 2
#: A shingle of up to so many sets' first ones is counted pair by pair.
SMALL = 64
#: One of so many sets whose first shingles are counted, how often one must occur there to go last, and how many of them are sent to all workers.
ONE_OF, OFTEN, FREQUENT = 16, 4, 400_000
#: Shingles that two candidates share at least: one for so many of a set's, up to the second number.
SHARED_OF, SHARED_MOST = 12, 16
#: Shingles of a candidate component that one slice or block holds; a task compares two blocks at once.
BLOCK_SHINGLES = 1 << 18
#: Pairs that a task makes at once.
PAIRS = 1 << 18
#: Up to so many rows of ids are sent to all workers at once (16 bytes each). More of them fetch their texts turn by turn, up to so many times; texts that nobody asks for are never shuffled.
BROADCAST_IDS, TURNS = 500_000, 32
#: Sets of a slice or block, and of a component that is compared at once; pivots of a larger one.
SLICE, PIVOTS = 256, 3

Order = tuple[np.ndarray, np.ndarray]


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct word shingles of a text, A-Z lower-cased, as sorted numbers; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w, seed) for w in place]), ">u8").astype(np.uint64)
    each = hashes[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
    n, mixed = max(1, len(words) - width + 1), np.uint64(0)
    for k in range(min(width, len(words))):
        mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def ordered(found: np.ndarray, order: Order) -> np.ndarray:
    """The shingles by their count in the sample, then by number."""
    known, counts = order
    if not len(known) or not len(found):
        return found
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return found[np.lexsort((found, np.where(known[at] == found, counts[at], 0)))]


def prefix_size(size, similarity: Fraction):
    """So many first shingles of a set hold one that every set of this similarity or more has among its own first ones."""
    return size + (-size * similarity.numerator // similarity.denominator) + 1


def least_shared(size, similarity: Fraction):
    """Shingles that a set's first ``prefix_size - 1 + least_shared`` share with those of a similar set that is no smaller; never more than must be common."""
    return np.clip(np.minimum(size // SHARED_OF, -(-size * similarity.numerator // similarity.denominator)), 1, SHARED_MOST)


def pairs_in_groups(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of many small groups of consecutive rows, without a loop over groups."""
    row = np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    after = np.repeat(start + size, size) - row - 1
    left = np.repeat(row, after)
    right = left + 1 + (np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after))
    return left, right


def stretches(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive items from i to j - 1 that weigh little more than ``most`` together, or one item that weighs more."""
    part = (np.cumsum(weights) - weights) // most
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    yield from zip(at.tolist(), [*at[1:].tolist(), len(part)])


def candidates(classes: DataFrame, similarity: Fraction, small: int = SMALL) -> DataFrame:
    """``(a, b)`` links whose components hold all similar classes together, from ``classes(key, size, first)``."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "under"):
            under, key, size = (t.column(c).to_numpy() for c in ("under", "key", "size"))
            start = np.flatnonzero(np.append(True, under[1:] != under[:-1]))
            rows = np.diff(np.append(start, len(under)))
            few = (rows > 1) & (rows <= small)
            starts, sizes = start[few], rows[few]
            for i, j in stretches(sizes * (sizes - 1) // 2, PAIRS):
                x, y = pairs_in_groups(starts[i:j], sizes[i:j])
                ok = np.flatnonzero(np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num)
                x, y = x[ok], y[ok]
                need = least_shared(np.minimum(size[x], size[y]), similarity)
                columns = np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), need.astype(np.int64), np.ones(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "need", "n"])
            for s, n in zip(start[rows > small].tolist(), rows[rows > small].tolist()):
                rest, least = key[s : s + n], key[s : s + n].min()
                columns = np.full(n, least), rest, np.zeros(n, np.int64), np.full(n, SHARED_MOST)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "need", "n"])

    postings = classes.select(F.explode("first").alias("under"), "key", "size")
    found = postings.repartition("under").sortWithinPartitions("under").mapInArrow(run, "a long, b long, need long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need and a <> b").select("a", "b")


def key_of(found: np.ndarray) -> int:
    """A class's signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def sample_order(docs: DataFrame, width: int, seed: int, rows: int = SAMPLE_ROWS) -> Order:
    n = docs.count()
    some = docs if n <= rows else docs.where(F.pmod(F.xxhash64("text_key"), F.lit(1_000_000)) < int(1_000_000 * rows / n) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in rows_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, width, seed).view(np.int64))], ["shingle"])

    counts = some.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= LEAST_COUNT)
    got = counts.orderBy(F.desc("count"), "shingle").limit(COUNTED).toArrow()  # at most COUNTED rows
    known, often = (got.column(c).to_numpy() for c in ("shingle", "count"))
    by = np.argsort(known.view(np.uint64))
    return known.view(np.uint64)[by], often[by]


def similar_pairs(start: np.ndarray, found: np.ndarray, similarity: Fraction, asking: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose links join all sets of this similarity or more; set i is ``found[start[i]:start[i + 1]]``, in the shared order.

    With ``asking`` only pairs that have one of the first so many sets are wanted."""
    num, den = similarity.numerator, similarity.denominator
    size = np.diff(start)
    first = prefix_size(size, similarity)
    kinds, number = np.unique(found, return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    early = np.flatnonzero(np.arange(len(found)) - start[owner] < first[owner])
    early = early[np.argsort(number[early], kind="stable")]
    under, has = np.searchsorted(number[early], np.arange(len(kinds) + 1)), owner[early]
    joined, mark = np.arange(len(size)), np.zeros(len(kinds), bool)
    stretch = lambda s, n: np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
    a, b = [], []
    for u in range(len(size) if asking is None else asking):
        own = number[start[u] : start[u + 1]]
        s, n = under[own[: first[u]]], under[own[: first[u]] + 1] - under[own[: first[u]]]
        s, n = s[n > 1], n[n > 1]
        if not len(s):
            continue
        near = has[stretch(s, n)]
        near = np.unique(near[(near > u) & (joined[near] != joined[u])])
        near = near[np.minimum(size[near], size[u]) * den >= np.maximum(size[near], size[u]) * num]
        if not len(near):
            continue
        mark[own] = True
        both = np.add.reduceat(mark[number[stretch(start[near], size[near])]].astype(np.int64), np.cumsum(size[near]) - size[near])
        mark[own] = False
        near = near[both * den >= (size[near] + size[u] - both) * num]
        if len(near):
            a.append(np.full(len(near), u))
            b.append(near)
            joined[np.isin(joined, joined[near])] = joined[u]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def compared(dealt: DataFrame, similarity: Fraction) -> DataFrame:
    """``(a, b)`` keys of similar sets, from ``dealt(deal, key, asks, found)``: pairs of one deal of which a set asks; ``a`` asks.

    A deal that more than one task has to read is not cut, so its sets are bounded by who deals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "deal"):
            deal = t.column("deal").to_numpy()
            first = np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))
            ends = np.append(first, len(deal))
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                part = t.slice(i, j - i)
                keys, asks = part.column("key").to_numpy(), part.column("asks").to_numpy(zero_copy_only=False)
                order = np.lexsort((keys, ~asks))  # those that ask first; of equal keys one
                order = order[np.sort(np.unique(keys[order], return_index=True)[1])]
                key = keys[order]
                raw = part.column("found").take(pa.array(order)).to_pylist()
                start = np.append(0, np.cumsum([len(x) // 8 for x in raw])).astype(np.int64)
                a, b = similar_pairs(start, np.frombuffer(b"".join(raw), np.uint64), similarity, int(asks[order].sum()))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["a", "b"])

    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "a long, b long")


def verified_links(docs: DataFrame, members: DataFrame, order, similarity: Fraction, width: int, seed: int, block: int = BLOCK_SHINGLES, slice_: int = SLICE) -> DataFrame:
    """``(a, b)`` keys of classes that are similar, from ``members(rep_id, rep_key, key, size, component, sets, shingles)`` and the texts of ``docs``.

    ``sets`` and ``shingles`` are those of the whole component."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [ordered(shingles(t, width, seed), order.value).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(raw, pa.binary())], ["key", "deals", "found"])

    def meet(plan: DataFrame) -> DataFrame:
        """From ``plan(rep_id, rep_key, key, deals)``, deals as structs of deal and asks."""
        whole = texts_of(docs, plan).select("text", "key", "deals")
        made = whole.mapInArrow(sets, "key long, deals array<struct<deal:long,asks:boolean>>, found binary")
        return compared(made.select("key", "found", F.explode("deals").alias("d")).select("d.deal", "key", "d.asks", "found"), similarity)

    parts = lambda count, size: F.greatest(F.ceil(count / slice_), F.ceil(size / block)).cast("int")
    one = lambda deal, asks: F.struct(F.xxhash64(*deal).alias("deal"), asks.alias("asks"))
    every = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    yes, no = F.lit(True), F.lit(False)
    members = members.withColumn("slices", parts(F.col("sets"), F.col("shingles")))
    members = members.withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    large = members.where("slices > 1")
    few = F.transform(F.slice(F.array_sort(F.collect_list("k")), 1, PIVOTS), lambda k: k["key"])
    # the pivots of each slice first, so that no task collects a component
    by_slice = large.select("component", "slice", F.struct(F.xxhash64("key", F.lit(1)).alias("h"), "key").alias("k")).groupBy("component", "slice").agg(F.min("k").alias("k"))
    first = by_slice.groupBy("component", F.pmod(F.xxhash64("slice"), F.lit(64)).alias("part")).agg(F.min("k").alias("k")).groupBy("component").agg(few.alias("pivots"))
    first = compacted(first)
    planned = members.join(first.withColumnRenamed("component", "of"), F.col("component") == F.col("of"), "left").withColumn("pivot", F.coalesce(F.array_contains("pivots", F.col("key")), no))
    deals = (
        F.when(F.col("slices") == 1, F.array(one(["component"], yes)))
        .when(F.col("pivot"), every(F.col("slices"), lambda s: one(["component", s], yes)))
        .otherwise(F.array(one(["component", "slice"], no)))
    )
    links = compacted(meet(compacted(planned.select("rep_id", "rep_key", "key", deals.alias("deals")))))
    if first.isEmpty():
        return links
    # of each large component the pivot that joins most, and the sets that it or a pivot similar to it joins
    pivots = first.select(F.col("component").alias("of"), F.explode("pivots").alias("p"))
    both = links.union(links.select("b", "a"))
    stars = compacted(both.join(pivots, F.col("a") == F.col("p")).select("of", "p", "b").distinct())
    best = stars.groupBy("of", "p").count().groupBy("of").agg(F.max_by("p", F.struct("count", "p")).alias("best"))
    hub = compacted(
        stars.join(best.withColumnRenamed("of", "of_"), (F.col("p") == F.col("best")) & (F.col("of") == F.col("of_"))).join(pivots.select(F.col("p").alias("q")), F.col("b") == F.col("q"), "left_semi")
        .select(F.col("b").alias("hub")).union(best.select("best")).distinct()
    )
    home = stars.join(hub, F.col("p") == F.col("hub"), "left_semi").select(F.col("b").alias("in_key")).union(hub).distinct()
    rest = compacted(large.join(home, F.col("key") == F.col("in_key"), "left_anti").select("component", "key", "size"))
    counts = compacted(rest.groupBy(F.col("component").alias("of")).agg(parts(F.count("*"), F.sum("size")).alias("rests")))
    if counts.isEmpty():
        return links
    left = large.join(counts, F.col("component") == F.col("of")).join(rest.select(F.col("key").alias("rest_key")), F.col("key") == F.col("rest_key"), "left")
    mine = F.pmod(F.xxhash64("key", F.lit(2)), F.col("rests")).cast("int")
    as_all = every(F.col("rests"), lambda r: one(["component", r, "slice"], no))
    as_rest = every(F.col("slices"), lambda s: one(["component", mine, s], yes))
    deals = F.when(F.col("rest_key").isNull(), as_all).otherwise(F.concat(as_all, as_rest))
    return links.union(meet(compacted(left.select("rep_id", "rep_key", "key", deals.alias("deals")))))


def narrow(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, a table at hand of a few numbers a row, to be sent to all workers if it is small enough; wide tables that meet it aren't shuffled then."""
    return F.broadcast(ids) if ids.count() <= most else ids


def texts_of(docs: DataFrame, wanted: DataFrame, most: int = BROADCAST_IDS, turns: int = TURNS) -> DataFrame:
    """Rows of ``docs`` that ``wanted(rep_id, rep_key, ...)`` names, with its other columns; only their texts are shuffled."""
    ids = checkpointed(wanted.select(F.col("rep_id").alias("of_id"), F.col("rep_key").alias("of_key")))
    n = max(1, -(-ids.count() // most))
    if n <= turns:
        same = (F.col("doc_id") == F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
        turn = lambda rows, id_, key, i: rows if n == 1 else rows.where(F.pmod(F.xxhash64(id_, key, F.lit(5)), F.lit(n)) == i)
        docs = reduce(DataFrame.union, [turn(docs, "doc_id", "text_key", i).join(F.broadcast(turn(ids, "of_id", "of_key", i)), same, "left_semi") for i in range(n)])
    return docs.join(wanted, (F.col("doc_id") == F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")))


def signatures_of(docs: DataFrame, order, similarity: Fraction, width: int, seed: int) -> DataFrame:
    """``(doc_id, text_key, key, size, first)`` of each text of ``docs(doc_id, text_key, text)``: its class, the size of its set and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                keys, sizes, firsts = [], [], []
                for text in rows_of(part.column(2)):
                    found = shingles(text, width, seed)
                    keys.append(key_of(found))
                    sizes.append(len(found))
                    most = prefix_size(len(found), similarity) - 1 + least_shared(len(found), similarity) if len(found) else 0
                    firsts.append(ordered(found, order.value)[:most].view(np.int64))
                ends = np.append(0, np.cumsum([len(x) for x in firsts])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_key", "key", "size", "first"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, key long, size long, first array<long>")


def frequent(classes: DataFrame, order: Order, one_of: int = ONE_OF) -> tuple[DataFrame, Order]:
    """``(under, count)`` of shingles that are frequent among the first ones of some sets of ``classes(key, first)``, and the order in which they go last."""
    some = classes if one_of == 1 else classes.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(one_of)) == 0)
    counts = some.select(F.explode("first").alias("under")).groupBy("under").count().where(F.col("count") >= OFTEN)
    found = checkpointed(counts.orderBy(F.desc("count"), "under").limit(FREQUENT))
    got = found.toArrow()  # at most FREQUENT rows
    known, counts = order
    # behind all that the first sample counted, by their own count; of a shingle in both the later count stays
    new, often = got.column("under").to_numpy().view(np.uint64), got.column("count").to_numpy() + (counts.max() if len(counts) else 0)
    stay = ~np.isin(known, new)
    known, counts = np.concatenate([known[stay], new]), np.concatenate([counts[stay], often])
    by = np.argsort(known)
    return found, (known[by], counts[by])


def grouped_links(signed: DataFrame, also: DataFrame) -> DataFrame:
    """``(a, b)`` keys of classes whose texts stand in one group of ``also(text_key, group)``, each with the least of its group."""
    texts = signed.where("doc_id is not null").select(F.col("text_key").alias("of"), "key").distinct()
    met = compacted(also.join(texts, F.col("text_key") == F.col("of")).select("group", "key").distinct())
    least = met.groupBy(F.col("group").alias("g")).agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1")
    return met.join(least, F.col("group") == F.col("g")).where("a <> key").select("a", F.col("key").alias("b"))


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42, block: int = BLOCK_SHINGLES, sample: int = SAMPLE_ROWS, small: int = SMALL, slice_: int = SLICE, one_of: int = ONE_OF, also: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_key, component_id, kept)`` for every row: near duplicates by similarity of word shingles, A-Z lower-cased.

    Two rows link if the Jaccard similarity of their whole shingle sets is ``similarity`` or more; no pair is left out. ``component_id`` is the
    smallest doc_id reachable by links, itself included; ``text_key`` is Spark's ``xxhash64`` of the text. Of a component the
    row of least doc_id and text_key is kept; so are rows without a doc_id, which link nothing. Texts without words are alike, and like no
    other. Repeated rows are returned as often as they come; other columns are ignored; an empty table gives an empty
    result; a null doc_id has a null component if no row with a doc_id has its shingles. Texts that stand in one group of ``also(text_key, group)``, found by another method, are linked too.
    """
    t = Fraction(str(similarity))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    send = docs.sparkSession.sparkContext.broadcast
    order = send(sample_order(docs, shingle, seed, sample))
    signed = checkpointed(signatures_of(docs, order, t, shingle, seed))
    classes = checkpointed(
        signed.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("size").alias("size"), F.first("first").alias("first"))
    )
    often, later = frequent(classes, order.value, one_of)
    if not often.isEmpty():
        order = send(later)
        changed = compacted(classes.select("key", "rep", F.explode("first").alias("under")).join(narrow(often.select("under")), "under", "left_semi").select("key", "rep").distinct())
        rows = texts_of(docs, changed.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")))
        anew = checkpointed(signatures_of(rows, order, t, shingle, seed).dropDuplicates(["key"]).select("key", F.struct("doc_id", "text_key").alias("rep"), "size", "first"))
        kept = classes.join(narrow(changed.select(F.col("key").alias("changed"))), F.col("key") == F.col("changed"), "left_anti")
        classes = kept.union(anew)
    parts = connected_components(candidates(classes, t, small))
    inside = compacted(classes.join(parts, F.col("key") == F.col("node")).select("key", "rep", "size", "component"))
    sizes = inside.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    members = inside.join(sizes, F.col("component") == F.col("of")).select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "key", "size", "component", "sets", "shingles")
    links = verified_links(docs, members, order, t, shingle, seed, block, slice_)
    joined = connected_components(links if also is None else links.union(grouped_links(signed, also)))
    rooted = classes.join(joined, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("keeper"))
    named = checkpointed(rooted.join(least, F.col("root") == F.col("r")).select(F.col("key").alias("of"), F.col("keeper.doc_id").alias("component_id"), F.col("keeper.text_key").alias("keeper_key")))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("keeper_key"))
    return signed.select("doc_id", "text_key", "key").join(named, F.col("key") == F.col("of"), "left").select("doc_id", "text_key", "component_id", kept.alias("kept"))
