"""Near-duplicate documents by HyperMinHash.

1. Each text becomes its set of word shingles and a HyperMinHash sketch: the
   hashes fall into 256 buckets, and a bucket keeps the leading-zero count and
   10 mantissa bits of its least hash. Texts with the same words share one
   digest and go on as one node, whatever their ids.
2. Bands of six registers retrieve candidates. Empty registers borrow that of
   another bucket, in an order fixed per bucket, so short texts fill their
   bands too. With 42 bands a pair at similarity 0.85 is missed with a
   probability of 3e-9. A bucket links its members to its least member, so its
   cost is linear; the clusters of these stars hold every candidate pair.
3. The candidates are verified in three rounds, each by the collision-corrected
   Jaccard estimate of the sketches, which rules pairs out five standard
   deviations below the threshold, and then on the full shingle sets. First
   every text meets the hub that it shares most bands with; the groups that
   this links are contracted. Then every text meets its best hub in another
   group. What is left are pairs of different groups in one cluster. A cluster
   of one block is verified as it is. In a larger one, two texts that are
   linked must share one of the rarest shingles of both: of the larger set
   one in about the first 15 %, of the smaller in about the first 8 %. So its
   texts are dealt by these shingles, and only those that different groups
   hold on both sides are looked at, each text once for every group that it
   meets; pages of one template whose fillings differ too much to be linked
   never meet. Rounds return only links that span components, never all pairs.
4. Connected components of the verified links name the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import carried, cut, named, scratch, worker_state
from weftline.llm.graph import components

#: log2 of the registers, mantissa bits, registers of a band and bands.
P, R, ROWS, BANDS = 8, 10, 6, 42
EMPTY = np.uint16(0xFFFF)
#: A block holds at most about so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 20
#: Buckets in which texts' shingles are counted to tell rare ones.
COUNTERS = 1 << 18
#: Groups under one rare shingle that are paired; of more, the shingle itself is what brings them together.
FEW = 64
#: Bytes of words, and of what goes with each, whose hashes a worker keeps at once.
CACHE = 16 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    used = 0

    def __missing__(self, word: bytes) -> int:
        if self.used > CACHE:
            self.clear()
            self.used = 0
        self[word] = h = xxhash.xxh64_intdigest(word)
        self.used += len(word) + 160
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def text_words(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return text.lower().split() if text else []


def shingles(words: list[bytes], hashes: dict, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; of fewer words, one hash of them all."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    h = w[: n - size + 1]
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * _M1 + w[k : n - size + 1 + k]
    return np.unique(_mixed(h))


_EDGES = np.arange(1 << P, dtype=np.uint64) << np.uint64(64 - P)
_TURNS = np.array([np.random.default_rng(k).permutation(1 << P) for k in range(1 << P)])


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty sorted set: leading zeros and mantissa of each bucket's least hash, EMPTY without one."""
    at = np.searchsorted(s, _EDGES)
    found = np.minimum(at, len(s) - 1)
    least = s[found]
    full = (at < len(s)) & (least >> np.uint64(64 - P) == np.arange(1 << P, dtype=np.uint64))
    v = (least >> np.uint64(8)) & np.uint64((1 << 48) - 1)  # the 48 bits below the bucket's number
    zeros = 48 - np.frexp(v.astype(np.float64))[1].astype(np.uint64)
    mantissa = ((v << zeros) & np.uint64((1 << 47) - 1)) >> np.uint64(47 - R)
    return np.where(full, (zeros << np.uint64(R) | mantissa).astype(np.uint16), EMPTY)


def filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers replaced by the first full one in the order of their bucket."""
    full = regs != EMPTY
    holes = np.flatnonzero(~full)
    if not len(holes):
        return regs
    out = regs.copy()
    turns = _TURNS[holes]
    out[holes] = regs[turns[np.arange(len(holes)), full[turns].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = filled(regs)[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for k in range(ROWS):
        h = (h ^ (h >> np.uint64(29))) * _M1 + rows[:, k]
    return _mixed(h).view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state(("near_dup",), _WordHashes)
        for b in batches:
            n, digest, keys = [], [], []
            texts = b.column("text").cast(pa.binary())
            for i in range(b.num_rows):
                words = text_words(texts[i].as_py())
                s = shingles(words, hashes, size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                keys.append(band_keys(registers(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "n", "digest", "bands"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """Intersection sizes of all sets of a with all of b, through their common hashes."""
    out = np.zeros(len(a) * len(b), np.int64)
    ha, ia = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    hb, ib = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    order = np.argsort(hb, kind="stable")
    hb, ib = hb[order], ib[order]
    lo = np.searchsorted(hb, ha, "left")
    count = np.searchsorted(hb, ha, "right") - lo
    ia, lo, count = (x[count > 0] for x in (ia, lo, count))
    parts = np.cumsum(count) // most if len(count) else count
    for k in np.unique(parts):
        p = parts == k
        c, first = count[p], np.cumsum(count[p]) - count[p]
        cols = ib[np.repeat(lo[p] - first, c) + np.arange(c.sum())]
        out += np.bincount(np.repeat(ia[p], c) * len(b) + cols, minlength=len(out))
    return out.reshape(len(a), len(b))


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair of sketches may reach the threshold.

    Matching full registers, less the expected chance collisions, over the
    registers that either has; five standard deviations are allowed for.
    """
    full_a, full_b = a != EMPTY, b != EMPTY
    out = np.empty((len(a), len(b)), bool)
    for i in range(len(a)):
        same = ((a[i] == b) & full_a[i]).sum(axis=1)
        either = (full_a[i] | full_b).sum(axis=1)
        ratio = np.maximum(na[i], nb) / np.minimum(na[i], nb)
        chance = 0.169919487159739 * 2.0 ** (P - R) * 4 * ratio / (1 + ratio) ** 2
        slack = 5 * np.sqrt(threshold * (1 - threshold) / either) + 2 / either
        out[i] = ((same - chance) / either >= threshold - slack) & (ratio * threshold <= 1 + 1e-9)
    return out


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member of its component) in a symmetric boolean matrix."""
    label = np.arange(len(link))
    while True:
        near = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return [(i, int(x)) for i, x in enumerate(label) if i != x]
        label = new


def links_between(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int, may: np.ndarray | None = None) -> np.ndarray:
    """Which sets of left and right are linked (among those that may be): ruled out by their sketches or else verified in full."""
    link = np.zeros((len(left), len(right)), bool)
    if not link.size:
        return link
    n, m = (np.array([len(s) for s in side]) for side in (left, right))
    maybe = estimates(np.array([registers(s) for s in left]), np.array([registers(s) for s in right]), n, m, num / den)
    if may is not None:
        maybe &= may
    if maybe.sum() <= 64:
        for x, y in zip(*np.nonzero(maybe), strict=True):
            both = len(np.intersect1d(left[x], right[y], assume_unique=True))
            link[x, y] = den * both >= num * (n[x] + m[y] - both)
    else:
        rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        both = overlaps([left[k] for k in rows], [right[k] for k in cols])
        link[np.ix_(rows, cols)] = maybe[np.ix_(rows, cols)] & (den * both >= num * (n[rows][:, None] + m[cols][None, :] - both))
    return link


def block_links(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links between members of different groups in a block: between its sides, or among all where it has no side 1."""
    two = bool(side.any())
    left = np.flatnonzero(side == 0) if two else np.arange(len(sets))
    right = np.flatnonzero(side == 1) if two else left
    may = group[left][:, None] != group[right][None, :]
    if not two:
        may &= left[:, None] < right[None, :]
    link = np.zeros((len(sets), len(sets)), bool)
    link[np.ix_(left, right)] = links_between([sets[k] for k in left], [sets[k] for k in right], num, den, may)
    return _spanning(link | link.T)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _hub_verified(size: int, num: int, den: int):
    """Over rows sorted by hub, salt and side: the hub's own texts first, then its members', of which only so many as a block has are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state(("near_dup",), _WordHashes)
        key, hub, ids, sets, held = None, [], [], [], 0

        def links() -> pa.RecordBatch:
            linked = links_between(sets, hub, num, den).any(axis=1) if hub else []
            return _edges([(ids[k], key[0]) for k in np.flatnonzero(linked)])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("hub", "salt", "side", "node")]
            texts = b.column("text").cast(pa.binary())
            for i, (at, salt, side, node) in enumerate(zip(*columns, strict=True)):
                if key != (at, salt) or len(ids) >= BLOCK_TEXTS or held >= BLOCK_SHINGLES:
                    if ids:
                        yield links()
                    ids, sets, held = [], [], 0
                    if key != (at, salt):
                        key, hub = (at, salt), []
                s = shingles(text_words(texts[i].as_py()), hashes, size)
                if side == 0:
                    if not any(np.array_equal(s, h) for h in hub):
                        hub.append(s)
                else:
                    ids.append(node)
                    sets.append(s)
                    held += len(s)
        if ids:
            yield links()

    return run


def _hub_links(edges: DataFrame, texts: DataFrame, sizes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The edges (a, hub) that hold on the full sets. A hub of many members is split, its own text going to every part."""
    load = edges.join(sizes, F.col("a") == F.col("rep")).groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    load = load.select(F.col("hub").alias("h"), "parts")
    member = edges.join(load, F.col("hub") == F.col("h")).select("hub", F.pmod(F.xxhash64("a"), F.col("parts").cast("long")).cast("int").alias("salt"), F.lit(1).alias("side"), "a")
    own = load.select(F.col("h").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("h").alias("a"))
    rows = member.unionByName(own).join(texts, F.col("a") == F.col("node")).select("hub", "salt", "side", "node", "text")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side").mapInArrow(_hub_verified(size, num, den), "a long, b long")


def _verified(keys: list[str], size: int, num: int, den: int):
    """Over rows sorted by keys: the links in each block, between different groups and, where a block has two sides, between these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_state(("near_dup",), _WordHashes)
        key, rows = None, []

        def links() -> pa.RecordBatch:
            sets = [shingles(text_words(t), hashes, size) for *_, t in rows]
            found = block_links(sets, np.array([g for _, g, _, _ in rows]), np.array([s for _, _, s, _ in rows]), num, den)
            return _edges([(rows[i][0], rows[j][0]) for i, j in found])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*keys, "node", "group", "side")]
            texts = b.column("text").cast(pa.binary())
            for i, row in enumerate(zip(*columns, strict=True)):
                if key != row[: len(keys)]:
                    if len(rows) > 1:
                        yield links()
                    key, rows = row[: len(keys)], []
                rows.append((*row[len(keys) :], texts[i].as_py()))
        if len(rows) > 1:
            yield links()

    return run


def _named(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """nodes with group: the component of each, itself if it has no link."""
    return nodes.join(groups.select(F.col("node").alias("__n"), "component"), F.col("node") == F.col("__n"), "left").withColumn("group", F.coalesce("component", "node")).drop("__n", "component")


def _fill() -> Column:
    """How many blocks the rows take, with n shingles each."""
    return F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)


def _buckets(s: np.ndarray, cluster: int) -> np.ndarray:
    """The shingles' names in a cluster."""
    return _mixed(s ^ (np.uint64(cluster & ((1 << 64) - 1)) * _M1))


def _tally(size: int):
    """(bucket, n): how many texts of a task hold a shingle in each of COUNTERS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = worker_state(("near_dup",), _WordHashes), np.zeros(COUNTERS, np.int64)
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for i, cluster in enumerate(b.column("cluster").to_pylist()):
                np.add.at(n, (_buckets(shingles(text_words(texts[i].as_py()), hashes, size), cluster) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return run


def _rarest(counts: Broadcast, size: int, num: int, den: int):
    """(post, node, group, n, side): a text under its rarest shingles, those that it may be found by on side 0, and those that it seeks smaller sets with on side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = worker_state(("near_dup",), _WordHashes), counts.value
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for i, (node, cluster, group) in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "cluster", "group")), strict=True)):
                s = _buckets(shingles(text_words(texts[i].as_py()), hashes, size), cluster)
                seek, found = len(s) - -(-num * len(s) // den) + 1, len(s) - -(-2 * num * len(s) // (num + den)) + 1
                first = s[np.lexsort((s, often[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:seek]].view(np.int64)
                post, side = np.concatenate([first[:found], first]), np.repeat([0, 1], [min(found, len(first)), len(first)])
                many = lambda v, n=len(post): pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(post), many(node), many(group), many(len(s)), pa.array(side.astype(np.int32))], ["post", "node", "group", "n", "side"])

    return run


def _postings(left: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(post, node, group, n, side) of left (node, cluster, group, text): what is to be compared, side 0 with side 1 of each post.

    Two groups that meet under a few shingles, or under thousands, are one
    post of those texts that meet, so a text comes once for each group that it
    meets. Only a shingle of more than FEW groups is a post of its own.
    """
    counted = left.select("cluster", "text").mapInArrow(_tally(size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
    often = np.zeros(COUNTERS, np.int64)
    often[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    entries = cut(left.select("node", "cluster", "group", "text").mapInArrow(_rarest(left.sparkSession.sparkContext.broadcast(often), size, num, den), "post long, node long, group long, n long, side int"))
    held = entries.groupBy("post", "group", "side").agg(F.lit(1).alias("one")).drop("one")
    met = cut(held.groupBy(F.col("post").alias("p")).agg(F.min("group").alias("g"), F.max("group").alias("h"), F.min("side").alias("s"), F.count_distinct("group").alias("groups")).where("g <> h and s = 0").select("p", "groups"))
    entries = cut(entries.join(met, F.col("post") == F.col("p")).drop("p"))
    few = entries.where(F.col("groups") <= FEW)
    others = few.groupBy(F.col("post").alias("p"), F.col("group").alias("other"), F.col("side").alias("far")).agg(F.lit(1).alias("one")).drop("one")
    pairs = few.join(others, (F.col("post") == F.col("p")) & (F.col("group") != F.col("other")) & (F.col("side") != F.col("far")))
    pair = F.when(F.col("side") == 0, F.xxhash64("group", "other")).otherwise(F.xxhash64("other", "group"))
    pairs = pairs.groupBy(pair.alias("post"), "node", "group", "n", "side").agg(F.lit(1).alias("one")).drop("one")
    return cut(pairs.unionByName(entries.where(F.col("groups") > FEW).drop("groups")))


def _sided_blocks(entries: DataFrame) -> DataFrame:
    """(post, lo, hi, node, group, side): the pairs of a side 0's block and a side 1's that each entry takes part in.

    On each side, large groups have blocks of their own and small groups share
    blocks, each whole in one; two blocks of one group never meet.
    """
    groups = cut(entries.groupBy("post", "side", "group").agg(_fill().alias("fill")))
    upto = Window.partitionBy("post", "side").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    large = groups.where("fill > 0.5").withColumn("parts", F.ceil("fill").cast("int"))
    large = cut(large.select("post", "side", "group", "parts", F.coalesce(F.sum("parts").over(upto), F.lit(0)).cast("int").alias("first")))
    sizes = groups.groupBy(F.col("post").alias("tp"), F.col("side").alias("ts")).agg(F.coalesce(F.sum(F.when(F.col("fill") > 0.5, F.ceil("fill"))), F.lit(0)).cast("int").alias("owned"), F.ceil(F.coalesce(F.sum(F.when(F.col("fill") <= 0.5, F.col("fill"))), F.lit(0.0))).cast("int").alias("common"))
    sizes = cut(sizes)
    named_large = lambda p: large.select(*(F.col(c).alias(f"{p}_{c}") for c in large.columns))
    own, far = named_large("own"), named_large("far")
    placed = entries.join(own, (F.col("post") == F.col("own_post")) & (F.col("side") == F.col("own_side")) & (F.col("group") == F.col("own_group")), "left")
    placed = placed.join(far, (F.col("post") == F.col("far_post")) & (F.col("side") != F.col("far_side")) & (F.col("group") == F.col("far_group")), "left")
    placed = placed.join(sizes, (F.col("post") == F.col("tp")) & (F.col("side") == F.col("ts"))).drop("tp", "ts")
    other = sizes.select(F.col("tp").alias("op"), F.col("ts").alias("os"), (F.col("owned") + F.col("common")).alias("others"))
    placed = placed.join(other, (F.col("post") == F.col("op")) & (F.col("side") != F.col("os")))
    at = F.coalesce(F.col("own_first") + F.pmod(F.xxhash64("node"), F.col("own_parts").cast("long")).cast("int"), F.col("owned") + F.pmod(F.xxhash64("group"), F.greatest("common", F.lit(1)).cast("long")).cast("int"))
    meets = F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.col("far_first").isNull() | (x < F.col("far_first")) | (x >= F.col("far_first") + F.col("far_parts")))
    placed = placed.select("post", "node", "group", "side", at.alias("at"), F.explode(meets).alias("other"))
    turned = lambda a, b: F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b))
    return placed.select("post", turned("at", "other").alias("lo"), turned("other", "at").alias("hi"), "node", "group", "side")


def _rest_links(nodes: DataFrame, texts: DataFrame, sizes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links between different groups of one cluster, of nodes (node, cluster, group) and their texts."""
    sized = nodes.join(sizes, F.col("node") == F.col("rep")).select("node", "cluster", "group", "n")
    several = sized.groupBy(F.col("cluster").alias("c")).agg(F.min("group").alias("g"), F.max("group").alias("h"), _fill().alias("fill")).where("g <> h").select("c", "fill")
    left = sized.join(several, F.col("cluster") == F.col("c")).select("node", "cluster", "group", "fill")
    left = cut(left.join(texts.withColumnRenamed("node", "t"), F.col("node") == F.col("t")).select("cluster", "node", "group", F.lit(0).alias("side"), "fill", "text"))
    out = "a long, b long"
    links = left.where("fill <= 1").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_verified(["cluster"], size, num, den), out)
    large = left.where("fill > 1")
    if large.isEmpty():
        return links
    dealt = _sided_blocks(_postings(large, size, num, den)).join(large.select(F.col("node").alias("t"), "text"), F.col("node") == F.col("t"))
    keys = ["post", "lo", "hi"]
    return links.unionByName(dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_verified(keys, size, num, den), out))


def _groups(docs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """A table (doc_id, key, n, digest, component) of docs (doc_id, key, text).

    digest names the text by its words and is null if it has none; component
    is a number that all texts of a group, and no others, have.
    """
    if not 0.8 <= num / den <= 1:
        raise ValueError("the bands hold for similarities from 0.8 to 1")
    with scratch() as keep:
        sketches = cut(docs.mapInArrow(_sketches(size), "doc_id long, key string, n long, digest binary, bands array<bigint>"))
        d = sketches.select("doc_id", "key", "n", F.hex("digest").alias("digest"))
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
        reps = sketches.where("n > 0").groupBy("digest").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        reps = cut(reps.select(F.hex("digest").alias("digest"), "row", "n", "bands", F.monotonically_increasing_id().alias("rep")))
        sizes = reps.select("rep", "n")
        banded = reps.select("rep", F.explode("bands").alias("k"))
        hubs = banded.groupBy("k").agg(F.min("rep").alias("hub"), F.max("rep").alias("__last")).where("hub < __last").select(F.col("k").alias("__k"), "hub")
        star = cut(banded.join(hubs, F.col("k") == F.col("__k")).where("rep <> hub").groupBy(F.col("rep").alias("a"), "hub").agg(F.count(F.lit(1)).alias("bands")))

        nodes = components(star.select("a", F.col("hub").alias("b")), stored=True).withColumnRenamed("component", "cluster")
        texts = _texts(docs, nodes, reps)
        best = F.struct(F.col("bands"), -F.col("hub"))
        first = star.groupBy("a").agg(F.max_by("hub", best).alias("hub"))
        one = components(_hub_links(first, texts, sizes, size, num, den))

        of = one.select(F.col("node").alias("hub_node"), F.col("component").alias("hub_group"))
        rest = _named(star.withColumn("node", F.col("a")), one).join(of, F.col("hub") == F.col("hub_node"), "left").withColumn("hub_group", F.coalesce("hub_group", "hub"))
        rest = rest.join(first.select(F.col("a").alias("fa"), F.col("hub").alias("fh")), (F.col("a") == F.col("fa")) & (F.col("hub") == F.col("fh")), "left_anti")
        rest = cut(rest.where(F.col("group") != F.col("hub_group")).groupBy("a").agg(F.max_by("hub", best).alias("hub")))
        so_far = one.select(F.col("node").alias("a"), F.col("component").alias("b"))
        two = components(so_far.unionByName(_hub_links(rest, texts, sizes, size, num, den)))

        links = _rest_links(_named(nodes, two), texts, sizes, size, num, den)
        so_far = two.select(F.col("node").alias("a"), F.col("component").alias("b"))
        named_groups = components(so_far.unionByName(links))
        grouped = reps.join(named_groups, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("__d"), F.coalesce("component", "rep").alias("component"))
        out = d.where("digest is not null").join(grouped, F.col("digest") == F.col("__d")).drop("__d")
        return keep(cut(out.unionByName(d.where("digest is null").withColumn("component", F.lit(None).cast("long")))))


def _texts(docs: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """A table (node, text) of the texts of nodes, each once."""
    chosen = reps.select("rep", "row.doc_id", "row.key").join(nodes.select("node"), F.col("rep") == F.col("node"), "left_semi")
    chosen = chosen.select(F.col("rep").alias("node"), F.col("doc_id").alias("i"), F.col("key").alias("k"))
    texts = cut(docs.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).select("node", "text"))
    if not texts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # repeated rows, or copies without an id
        texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")))
    return texts


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = named(text_col)
    return named(id_col).cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), text.alias("text")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked where den * |intersection| >= num * |union| (num/den
    of 0.8 or more). A null text, or one without words, has no shingles and is
    linked with nothing. Texts are taken whole, however long, as bytes, so
    invalid UTF-8 is compared as it is. Links are between texts: rows that
    share an id but no text are in groups of their own. component_id is the
    least id in the group, null where no row of it has one; kept says whether
    it is the row's own, and is true of all rows of a group without ids, and
    of those without words. Repeated rows get equal results. An empty table
    gives an empty one. Names of other columns cannot clash: they are not read.
    """
    found = _groups(docs.select(*_keyed(docs, id_col, text_col)), num, den, size)
    least = cut(found.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("least")))
    out = found.where("component is not null").join(least, F.col("component") == F.col("c")).select("doc_id", "n", "least")
    out = out.unionByName(found.where("component is null").select("doc_id", "n", F.col("doc_id").alias("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, size: int = 5) -> DataFrame:
    """The rows of docs that stay: one of each group, with all their columns.

    The one is the row of the least id, one with an id before one without;
    of those that tie, that of the least text by MD5, and any one of them where
    texts are equal too. Rows that share an id but belong to different groups
    are told apart by their texts. Rows without words, or without a text, are
    in no group and stay. Rows are carried as structs, so no name of their
    columns can clash; an empty table gives an empty one.
    """
    doc_id, key, text = _keyed(docs, id_col, text_col)
    found = _groups(docs.select(doc_id, key, text), num, den, size)
    named_rows = cut(found.where("component is not null").groupBy("component", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    best = cut(named_rows.groupBy(F.col("component").alias("c")).agg(F.min(order).alias("best")))
    judged = cut(named_rows.join(best, F.col("component") == F.col("c")).select(F.col("doc_id").alias("i"), F.col("key").alias("k"), (order == F.col("best")).alias("stays"), "rows"))
    rows = docs.select(carried(docs), doc_id.alias("id"), key)
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    left = rows.join(judged.where("not stays").hint("merge"), same, "left_anti")
    repeated = judged.where("stays and rows > 1").select("i", "k")
    if not repeated.isEmpty():
        one = left.join(repeated.hint("merge"), same, "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
        left = left.join(repeated.hint("merge"), same, "left_anti").select("row").unionByName(one.select("row"))
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
