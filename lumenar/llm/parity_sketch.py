"""Near-duplicate records by a parity-sketch join (problem 5).

Each text is a set of words. Words of at most ``RARE`` texts are rare, the others frequent; a text of ``n`` words has ``r`` rare and ``f`` frequent ones. Two texts whose overlap reaches ``t``
share at least ``t / (1 + t) * (n + m)`` words, so they differ in at most ``(1 - t) / (1 + t) * (n + m)``. They either

* share a rare word. In an order with the rare words first, their first common word stands within the first ``n - t * n + 1`` words of either list, and within the first
  ``n - 2 * t / (1 + t) * n + 1`` of the smaller text's; they meet on that word.
* or share none. Then all their rare words differ, and their frequent words differ in at most ``h + h'`` words, where ``h = (1 - t) / (1 + t) * f - 2 * t / (1 + t) * r`` of each text. The frequent
  words, dealt out by rank so that no part gets all the common ones, are sketched in ``k > h + h'`` parts, of which by the pigeonhole principle more than ``k - (h + h')`` are the same in both.
  ``k`` goes by bands of the greater ``h``, which follows the size of the text. The text with the greater ``h`` leads: it has all its parts of its band as keys. A text that could be its
  partner has any ``h + h' + 1`` of them, of which one must be the same; it takes the most telling ones, so parts of nothing but common words meet hardly anything.

So no pair is missed, whatever the frequency of its words: an empty part is a part like any other, no word is left out, and there is no cap on keys or partners.

A parity sketch flips one bit per word, so the Hamming distance of two sketches never exceeds the number of words that only one of the texts has. A sketch of 128 bits over all words is compared
before any text is fetched. What is left is verified on the full word sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ordered_pair, small_enough, words
from .components import connected_components

#: Texts that a rare word stands in at most: a rare word joins at most so many rows, whatever the corpus.
RARE = 200
#: Most frequent words that are sent to the tasks (24 bytes each). A word is frequent only in more than (all texts' words) / ``MOST`` texts, so there cannot be more.
MOST = 1_000_000
#: Parts of the first band; each further band has ``STEP`` times as many.
FIRST, STEP = 4, 1.75
#: Words of texts that a task works on at once.
TOKENS_AT_ONCE = 1 << 20
#: What a key is for: the text may lead there, or be the partner of one that leads.
LEAD, PARTNER = 1, 2
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEYS, _ROWS = "key bigint, side int, use int", "key bigint, id bigint, side int, n int, s0 bigint, s1 bigint"
_SIDED = "key bigint, id bigint, n int, s0 bigint, s1 bigint"
#: Most bits, as a power of two, of the map of one side's keys that is sent to the tasks (32 MB), and bits of it that a task makes as one piece.
MAP_BITS, PIECE_BITS = 28, 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parity sketches (texts x 2 numbers of 64 bits): each word of a text flips one bit. ``starts``: where each text's words begin; every text has one."""
    bit, high = np.uint64(1) << (values & np.uint64(63)), (values >> np.uint64(6)) & np.uint64(1) == 1
    return np.stack([np.bitwise_xor.reduceat(np.where(high == w, bit, np.uint64(0)), starts) for w in (False, True)], axis=1)


def bands(largest: float) -> list[tuple[int, float, float]]:
    """(parts, least, below) of each band up to ``largest``: pairs whose greater ``h`` is from ``least`` on and under ``below`` are sketched in so many parts."""
    out, k, least = [], FIRST, 0.0
    while least <= largest:
        below = k / 2 - 1e-6  # so that h + h' < k
        out.append((k, least, below))
        least, k = below, int(k * STEP)
    return out


class _Words:
    """The frequent words of a corpus, and what a batch of texts (``values``: their words one text after another, ``sizes``) shows of them."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, threshold: float):
        falling = np.lexsort((hashes, -counts))
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int64)
        rank[falling] = np.arange(len(hashes))
        self.hashes, self.rank, self.weight, self.t = hashes[order], rank[order], 1.0 / np.log1p(counts[order].astype(np.float64)), threshold
        self.led: list[tuple[int, float, float]] = []

    def frequent(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        return at, self.hashes[at] == values

    def reach(self, f: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``h`` of each text and the greatest that a partner without common rare words can have."""
        u, v = (1 - self.t) / (1 + self.t), 2 * self.t / (1 + self.t)
        return u * f - v * r, u / self.t * f - u * r + 1e-6

    def keys(self, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, use) of every key of the texts."""
        t, rows = self.t, len(sizes)
        row = np.repeat(np.arange(rows), sizes)
        at, often = self.frequent(values)
        f = np.bincount(row[often], minlength=rows)
        r = sizes - f
        # rare words: the first ones of each text in the order of their hashes
        value, own = values[~often], row[~often]
        order = np.lexsort((value, own))
        value, own = value[order], own[order]
        place = np.arange(len(own)) - (np.cumsum(r) - r)[own]
        anyone, small = sizes - np.ceil(sizes * t - 1e-9), sizes - np.ceil(sizes * (2 * t / (1 + t)) - 1e-9)
        used = place <= anyone[own]
        out = [(own[used], _mix(value[used] ^ _C), PARTNER + LEAD * (place <= small[own])[used])]
        # frequent words: parts by band
        h, furthest = self.reach(f, r)
        for k, least, below in self.led:
            lead = (h >= least) & (h < below)
            partner = (np.abs(h) < below) & (furthest >= np.maximum(least, np.abs(h)))
            made = (f > 0) & (lead | partner)
            if not made.any():
                continue
            count, of = int(made.sum()), np.flatnonzero(made)
            chosen = often & made[row]
            cell = (np.cumsum(made) - 1)[row[chosen]] * k + self.rank[at[chosen]] % k
            parts, told = np.zeros(count * k, np.uint64), np.bincount(cell, self.weight[at[chosen]], count * k).reshape(count, k)
            np.add.at(parts, cell, _mix(values[chosen]))  # a sum in place of a parity: words are distinct, so either tells sets apart
            enough = np.where(partner, np.floor(h + np.minimum(below, furthest) + 1e-6) + 1, 0)[of]
            shown = np.empty((count, k), bool)
            np.put_along_axis(shown, np.argsort(-told, axis=1, kind="stable"), np.arange(k) < enough[:, None], axis=1)
            shown, leads = shown.ravel(), np.repeat(lead[of], k)
            name = np.tile(_mix(np.arange(k, dtype=np.uint64) * _A + np.full(k, k, np.uint64) * _C), count)
            use = shown | leads
            out.append((np.repeat(of, k)[use], _mix(parts ^ name)[use], LEAD * leads[use] + PARTNER * shown[use]))
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sides, words, sizes) of rows (``id``, ``side``, ``tokens``), no more than about ``TOKENS_AT_ONCE`` words at once unless one text has more."""
    for b in batches:
        tokens = b.column("tokens")
        flat, lengths = tokens.flatten().to_numpy().view(np.uint64), np.diff(tokens.offsets.to_numpy()).astype(np.int64)
        ids, sides, ends = b.column("id").to_numpy(), b.column("side").to_numpy(), np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            begin = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + TOKENS_AT_ONCE, "right")))
            yield ids[first:last], sides[first:last], flat[begin : ends[last - 1]], lengths[first:last]
            first = last


def _leaders(sets: DataFrame, corpus) -> list[int]:
    """Numbers of parts of the bands in which some text leads: a few numbers for each task reach the driver."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for _, _, values, sizes in _batches(batches):
            known = corpus.value
            f = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known.frequent(values)[1]], minlength=len(sizes))
            h = known.reach(f, sizes - f)[0]
            found |= {k for k, least, below in bands(h.max()) if ((h >= least) & (h < below)).any()}
        yield pa.record_batch([pa.array(sorted(found), pa.int32())], names=["k"])

    return [x.k for x in sets.mapInArrow(seen, "k int").distinct().collect()]


def frequent_words(sets: DataFrame, threshold: float, rare: int = RARE, most: int = MOST):
    """Broadcast words of more than ``rare`` texts, or of more than (all texts' words) / ``most`` if that is more. All texts are counted; at most ``most`` words reach the driver."""
    spark = sets.sparkSession
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    found = counts.filter(F.col("n") > max(rare, total / most)).toPandas()
    known = _Words(found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64), threshold)
    led = _leaders(sets, spark.sparkContext.broadcast(known))
    known.led = [x for x in bands(max(led, default=-2) / 2) if x[0] in led]
    return spark.sparkContext.broadcast(known)


def _keys(sets: DataFrame, corpus) -> DataFrame:
    """(``key``, ``side``, ``use``) of every key of each row of ``sets``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sides, values, sizes in _batches(batches):
            row, key, use = corpus.value.keys(values, sizes)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(sides[row]), pa.array(use.astype(np.int32))], names=["key", "side", "use"])

    return sets.mapInArrow(make, _KEYS)


def _rows(sets: DataFrame, corpus, use: int) -> DataFrame:
    """A row for each key of ``use``, with what a join compares: ``id``, ``side``, ``n`` and the sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sides, values, sizes in _batches(batches):
            row, key, used = corpus.value.keys(values, sizes)
            row, key = row[used & use > 0], key[used & use > 0]
            bits = sketches(values, np.cumsum(sizes) - sizes).view(np.int64)
            columns = [key.view(np.int64), ids[row], sides[row], sizes[row].astype(np.int32), bits[row, 0], bits[row, 1]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "id", "side", "n", "s0", "s1"])

    return sets.mapInArrow(make, _ROWS)


def _spots(key: np.ndarray, use: int, bits: int) -> np.ndarray:
    """Where each key, for one use, stands in a map of 2 ** ``bits`` bits."""
    return (_mix(key ^ (np.uint64(use) * _C)) >> np.uint64(64 - bits)).astype(np.int64)


def _key_map(sets: DataFrame, corpus) -> tuple[object, int]:
    """Broadcast map of the keys of ``sets`` by use, and the power of two of its bits. A bit may stand for several keys: what is not in the map is no key, what is in it may be one."""
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    bits = min(MAP_BITS, max(PIECE_BITS, int(8 * total).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, values, sizes in _batches(batches):
            _, key, use = corpus.value.keys(values, sizes)
            at = np.unique(np.concatenate([_spots(key[use & kind > 0], kind, bits) for kind in (LEAD, PARTNER)]))
            yield pa.record_batch([pa.array((at >> PIECE_BITS).astype(np.int32)), pa.array((at & ((1 << PIECE_BITS) - 1)).astype(np.int32))], names=["piece", "at"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            piece, at = b.column("piece").to_numpy(), b.column("at").to_numpy()
            for one in np.unique(piece):
                made.setdefault(int(one), np.zeros(1 << PIECE_BITS, bool))[at[piece == one]] = True
        yield pa.record_batch([pa.array(list(made), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in made.values()], pa.binary())], names=["piece", "bits"])

    whole, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (PIECE_BITS - 3)
    for x in sets.mapInArrow(places, "piece int, at int").repartition("piece").mapInArrow(pieces, "piece int, bits binary").toLocalIterator():
        whole[x.piece * width : (x.piece + 1) * width] = np.frombuffer(x.bits, np.uint8)
    return spark.sparkContext.broadcast(whole), bits


def _rows_across(sets: DataFrame, corpus, leads: int, met=None, bits: int = 0) -> DataFrame:
    """A row for each key and use of each text of one side, with what a join compares. The key says which side leads (``leads``: this side's own number), so no two leaders and no two partners meet.

    ``met``: a map of the other side's keys; then keys that meet none there are left out.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, values, sizes in _batches(batches):
            row, key, use = corpus.value.keys(values, sizes)
            rows, named = [], []
            for kind, other, leader in ((LEAD, PARTNER, leads), (PARTNER, LEAD, 1 - leads)):
                kept = np.flatnonzero(use & kind)
                if met is not None:
                    at = _spots(key[kept], other, bits)
                    kept = kept[(met.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                rows.append(row[kept])
                named.append(_mix(key[kept] + np.uint64(leader) * _A))
            row, key = np.concatenate(rows), np.concatenate(named)
            bit = sketches(values, np.cumsum(sizes) - sizes).view(np.int64)
            columns = [key.view(np.int64), ids[row], sizes[row].astype(np.int32), bit[row, 0], bit[row, 1]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "id", "n", "s0", "s1"])

    return sets.mapInArrow(make, _SIDED)


def candidate_pairs(sets: DataFrame, threshold: float, across: str | None = None, rare: int = RARE) -> DataFrame:
    """Distinct (``a``, ``b``), a < b, of rows of ``sets`` (``id`` bigint, unique; ``tokens`` array<bigint>, free of repeats within a row, not empty) whose sketches allow the threshold.

    ``across``: a column that is 0 or 1; then ``a`` is of the rows with 0 and ``b`` of those with 1. ``sets`` is read several times, so it should be a written table.
    """
    sided = sets.select("id", (F.col(across) if across else F.lit(0)).cast("int").alias("side"), "tokens")
    corpus = frequent_words(sided, threshold, rare)
    distance = F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))) + F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1")))
    most = (1 - threshold) / (1 + threshold)
    sizes = (F.col("a_n") >= F.col("b_n") * threshold - 1e-9) & (F.col("b_n") >= F.col("a_n") * threshold - 1e-9)
    close = sizes & (distance <= (F.col("a_n") + F.col("b_n")) * most + 1e-9)
    if across:
        # each side's rows are made in one pass, and only a leader of one side and a partner of the other are ever compared; of side 0 only keys that side 1 has too leave the task
        met, bits = _key_map(sided.filter("side = 1"), corpus)
        of = lambda rows, p: rows.select([F.col(c).alias(c if c == "key" else f"{p}_{c}") for c in ["key", "id", "n", "s0", "s1"]])
        a, b = of(_rows_across(sided.filter("side = 0"), corpus, 0, met, bits), "a"), of(_rows_across(sided.filter("side = 1"), corpus, 1), "b")
        return a.join(b, "key").filter(close).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    # keys at which no leader meets a partner are dropped by flags and counts that are combined before the shuffle
    flags = _keys(sided, corpus).groupBy("key").agg(F.bit_or("use").alias("f"), F.count(F.lit(1)).alias("c"))
    shared = small_enough(cut_lineage(flags.filter((F.col("c") > 1) & (F.col("f") == LEAD + PARTNER)).select("key")), 1_000_000)
    side = lambda use, p: _rows(sided, corpus, use).join(shared, "key", "left_semi").select([F.col(c).alias(c if c == "key" else f"{p}_{c}") for c in ["key", "id", "n", "s0", "s1"]])
    near = side(LEAD, "a").join(side(PARTNER, "b"), "key").filter(close)
    return ordered_pair(near.filter("a_id <> b_id"), "a_id", "b_id", "p").select(F.col("p_1").alias("a"), F.col("p_2").alias("b")).distinct()


def text_sets(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(``key``, ``id``, ``tokens``): the hashed distinct words of each row and, as ``id``, the hash of the whole set. Texts without words give an empty set."""
    tokens = F.array_sort(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))))
    return rows.select(F.col(key).alias("key"), tokens.alias("tokens")).withColumn("id", F.xxhash64("tokens"))


def near_duplicates(rows: DataFrame, key: str, text: Column, threshold: float = 0.7, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Membership (``key``, ``id``) and links (``a``, ``b``, ``overlap``) between the classes ``id`` of texts with equal word sets.

    Rows with a null key are left out, repeated rows of a key count once (by its least class), null texts are empty, and texts without a word join no class but that of the wordless.
    A group of copies of any size is one class: it is compared once, and only its membership lists it. No link between different texts is dropped: there is no cap on keys or partners.
    """
    keyed = text_sets(rows.filter(F.col(key).isNotNull()), key, text)
    member = cut_lineage(keyed.groupBy("key").agg(F.min_by("tokens", "id").alias("tokens"), F.min("id").alias("id")))
    sets = member.filter(F.size("tokens") > 0).groupBy("id").agg(F.first("tokens").alias("tokens"))
    pairs = candidate_pairs(sets, threshold, rare=rare)
    a, b = sets.select(F.col("id").alias("a"), F.col("tokens").alias("a_tokens")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("b_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    links = pairs.join(a, "a").join(b, "b").select("a", "b", (both / (F.size("a_tokens") + F.size("b_tokens") - both)).alias("overlap")).filter(F.col("overlap") >= threshold - 1e-12)
    return member.select("key", "id"), links


def key_pairs(member: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of different keys, (``id_1``, ``id_2``), smaller first: those of linked classes and those within a class. For results whose columns ask for pairs of keys."""
    m1, m2 = member.select(F.col("id").alias("a"), F.col("key").alias("k1")), member.select(F.col("id").alias("b"), F.col("key").alias("k2"))
    across = links.select("a", "b").join(m1, "a").join(m2, "b")
    within = m1.join(m2.withColumnRenamed("b", "a"), "a").filter("k1 < k2")
    return ordered_pair(across.select("k1", "k2").unionByName(within.select("k1", "k2")), "k1", "k2", "id")


def duplicate_groups(member: DataFrame, links: DataFrame) -> DataFrame:
    """One row per key: (``id``, ``class_id``, ``links``, ``group_id``, ``group_size``): its class of equal word sets, the number of other classes linked to it and the group of all that are linked by chains."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")
    row = member.join(degree, "id", "left").join(groups, "id", "left").select(F.col("key").alias("id"), F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("group_id"))
    sizes = row.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return row.join(sizes, "group_id").select("id", "class_id", "links", "group_id", "group_size")
