"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprint each whole text (64 bits, majority vote over XXH64 hashes of word shingles).
2. Equal fingerprints are one class; only classes travel further, represented by the smallest id.
3. Count each bit and each pair of bits over all classes. Correlated bits go to the same partition;
   for 1 to radius+1 partitions, a dynamic programme chooses a threshold for each partition (-1
   leaves it out) so that the thresholds plus one sum to radius+1, at least estimated cost. Two
   fingerprints within the radius must then agree to within the threshold in some partition.
4. Each class is indexed under its bits of a partition and probes every value within the
   partition's threshold. Rows that meet are verified on all 64 bits. A bucket over ``BLOCK`` rows is dealt
   as pairs of blocks, so a task never holds more than two blocks and no candidate is lost; only
   links of a spanning forest leave a large bucket.
5. Connected components over the links.

``links`` can also ask for agreement of a sketch that travels with the fingerprint. Near duplicates by similarity of
word shingles need no fingerprint: ``storyloom.llm.similarity`` finds them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.session import checkpointed
from storyloom.llm.arrow import whole_groups, rows_of
from storyloom.llm.similarity import pairs_in_groups, similar_components  # noqa: F401
from storyloom.operators.components import connected_components

BITS = 64
#: Minwise samples of a sketch, a byte each: the standard error of a similarity of 0.8 is 0.035.
SAMPLES = 128
#: Rows of a bucket that one task compares at once.
BLOCK = 4096
#: Buckets up to this size are compared pair by pair, many at once.
SMALL = 32
#: Estimated seconds for a probe row (made, shuffled, sorted), and for a compared pair.
ROW_S, PAIR_S = 1.5e-6, 6e-9
#: Hot buckets up to this number are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number; 0 if the text has no word."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest, stops = xxhash.xxh64_digest, (ends[width - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), 65536):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], stops[i : i + 65536])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the signed 64-bit fingerprint of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(r, width, seed) for r in rows_of(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(text: str | None, shingle: int, factors: tuple[np.ndarray, np.ndarray], seed: int = 42) -> tuple[int, bytes]:
    """Fingerprint over the distinct words, and sketch of the distinct word shingles; zeros for a text without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0, bytes(SAMPLES)
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    raw = b"".join([xxhash.xxh64_digest(w, seed) for w in place])
    hashes = np.frombuffer(raw, ">u8").astype(np.uint64)
    ones = np.zeros(BITS, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for i in range(0, len(bits), 65536):
        ones += np.unpackbits(bits[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    fp = int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big")
    each = hashes[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
    n, rows = max(1, len(words) - shingle + 1), min(shingle, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(rows):
        mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    low = np.unique((mixed >> np.uint64(32)).astype(np.uint32))
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        v = low[i : i + 2048, None] * factors[0] + factors[1]
        best = np.minimum(best, (v ^ (v >> np.uint32(15))).min(axis=0))
    best = (best * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    return fp, best.astype(np.uint8).tobytes()


def signatures(docs: DataFrame, shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, sketch)`` of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(SAMPLES, seed)
        for batch in batches:
            both = [signature(t, shingle, factors, seed) for t in rows_of(batch.column(1))]
            fps = np.array([f for f, _ in both], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([k for _, k in both], pa.binary())], ["doc_id", "fp", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, sketch binary")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and of those in which bits i and j are both set, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 65536):
                bits = np.unpackbits(fps[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["k", "v"])

    got = classes.select("fp").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in got:  # 4,097 rows whatever the input
        flat[r["k"]] = r["v"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of (nearly) equal width; each grows from its most correlated free bit by the bit that correlates most with it."""
    free, groups = list(range(len(corr))), []
    for p in range(parts):
        want = math.ceil(len(free) / (parts - p))
        group = [max(free, key=lambda i: (sum(corr[i][j] for j in free), -i))]
        free.remove(group[0])
        while len(group) < want:
            group.append(max(free, key=lambda i: (sum(corr[i][j] for j in group), -i)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t bits of the group, for t from 0 to ``most``.

    Mean and variance of the number of differing bits follow from the pair counts; a beta-binomial
    distribution with these moments gives the shares, so correlated bits count as fewer.
    """
    w, p = len(group), np.diag(both)[group] / n
    p11 = both[np.ix_(group, group)] / n
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    mean_i = 2 * p * (1 - p)
    cov = 2 * (p11 * p00 + p10 * p01) - np.outer(mean_i, mean_i)
    mu, var = float(mean_i.sum()), float(cov.sum())
    if mu <= 0:
        return [1.0] * (most + 1)
    q = min(mu / w, 1 - 1e-9)
    rho = min(max((var / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-6), 0.99)
    a, b = q * (1 - rho) / rho, (1 - q) * (1 - rho) / rho
    lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    pmf = [math.comb(w, t) * math.exp(lb(t + a, w - t + b) - lb(a, b)) for t in range(most + 1)]
    return np.minimum(np.cumsum(pmf), 1.0).tolist()


def plan_partitions(n: int, both: np.ndarray, radius: int = 4, row_s: float = ROW_S) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost; partitions with threshold -1 are left out."""
    n = max(n, 1)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    best: tuple[float, list] = (math.inf, [])
    for parts in range(1, radius + 2):
        groups = group_bits(corr, parts)
        table = {0: (0.0, [])}  # thresholds plus one given so far -> cost, choice
        for g in groups:
            share, rows, step = within(n, both, g, radius), 0, {}
            costs = [0.0]
            for t in range(radius + 1):
                rows += math.comb(len(g), t)
                costs.append(n * (rows * row_s + n * share[t] * PAIR_S))
            for used, (cost, chosen) in table.items():
                for s in range(radius + 2 - used):
                    if (c := cost + costs[s]) < step.get(used + s, (math.inf,))[0]:
                        step[used + s] = (c, [*chosen, s - 1])
            table = step
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], [(g, t) for g, t in zip(groups, table[radius + 1][1]) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _variants(group: list[int], threshold: int) -> list[int]:
    """Every way to flip up to ``threshold`` bits of the group; the first flips none."""
    out, last = [0], [(0, -1)]
    for _ in range(threshold):
        last = [(m | 1 << group[j], j) for m, i in last for j in range(i + 1, len(group))]
        out += [m for m, _ in last]
    return out


def probes(classes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """``classes(fp, rep, sketch)`` with ``(part, bucket, own)``: for each class and partition, the values to look under; own marks its indexed value."""
    kinds = [
        F.struct(F.lit(i).alias("part"), F.lit(_signed(sum(1 << b for b in g))).alias("mask"), F.lit(_signed(v)).alias("flip"))
        for i, (g, t) in enumerate(plan)
        for v in _variants(g, t)
    ]
    return classes.select("fp", "rep", "sketch", F.explode(F.array(*kinds)).alias("k")).select(
        "fp", "rep", "sketch", "k.part", F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("bucket"), (F.col("k.flip") == 0).alias("own")
    )


def spanning_links(fp: np.ndarray, radius: int, sketch: np.ndarray | None = None, agree: int = 0) -> list[tuple[int, np.ndarray]]:
    """Links of a spanning forest of one bucket: each row is compared with rows not yet reached only."""
    links, left = [], np.arange(len(fp))
    while left.size:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            u = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[u]) <= radius
            if sketch is not None and near.any():
                at = np.flatnonzero(near)
                near[at] = (sketch[left[at]] == sketch[u]).sum(axis=1) >= agree
            if near.any():
                links.append((u, left[near]))
                queue.extend(left[near].tolist())
                left = left[~near]
    return links


def links(classes: DataFrame, plan: list[tuple[list[int], int]], radius: int = 4, block: int = BLOCK, agree: int = 0) -> DataFrame:
    """``(a, b)`` representatives of verified links; their components equal those of all links within the radius.

    With ``agree`` a link also needs so many equal samples of the column ``sketch``.
    """
    found = probes(classes if agree else classes.withColumn("sketch", F.lit(None).cast("binary")), plan)
    hot = checkpointed(
        found.groupBy("part", "bucket").count().where(F.col("count") > block)
        .select(F.col("part").alias("p"), F.col("bucket").alias("v"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = (F.col("part") == F.col("p")) & (F.col("bucket") == F.col("v"))
    dealt = found.join(F.broadcast(hot) if few else hot, on, "left").select(
        "fp", "rep", "sketch", "part", "bucket", "own", F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    mine = F.pmod(F.xxhash64("fp", "rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", other).select(
        "fp", "rep", "sketch", "own", F.xxhash64("part", "bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key, own = t.column("key").to_numpy(), t.column("own").to_numpy(zero_copy_only=False)
            fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1) if agree else None
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            a, b = [], []
            keep = (size > 1) & (size <= SMALL)
            starts, sizes = start[keep], size[keep]
            for i in range(0, len(starts), 8192):
                x, y = pairs_in_groups(starts[i : i + 8192], sizes[i : i + 8192])
                ok = np.flatnonzero((own[x] | own[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= radius))
                x, y = x[ok], y[ok]
                if agree:
                    ok = (sketch[x] == sketch[y]).sum(axis=1) >= agree
                    x, y = x[ok], y[ok]
                a.append(rep[x])
                b.append(rep[y])
            for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                for u, near in spanning_links(fp[s : s + n], radius, sketch[s : s + n] if agree else None, agree):
                    a.append(np.full(len(near), rep[s + u]))
                    b.append(rep[s + near])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Two rows link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest doc_id reachable by links, itself included. Null and empty texts, and texts of white space only,
    have fingerprint zero and link like any other. Repeated rows are returned as often as they
    come; other columns are ignored; an empty table gives an empty result; a null doc_id is kept,
    with a null component if nothing else shares its fingerprint.
    """
    prints = checkpointed(fingerprints(docs, width, seed))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = classes.where("rep is not null")
    n, both = bit_statistics(known)
    parts = connected_components(links(known, plan_partitions(n, both, radius), radius, block))
    named = checkpointed(
        classes.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    )
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
