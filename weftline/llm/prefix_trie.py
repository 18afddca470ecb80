"""The prefix trie of conversations, built level by level.

1. Turns get their places by range partitioning (never a window over one
   conversation), and each becomes a 128-bit digest and a word count, so texts
   are not shuffled. Conversations with equal turns form one class and go on
   as one, named by its least id.
2. Depth by depth, the live classes are grouped by (node, next turn); the
   group is a node of the next depth, named by its least conversation. A class
   that is alone in its node leaves the loop: what is left of it is a chain,
   and a chain's counts have a closed form (sums over the turns behind). So
   there are as many rounds as the deepest turn that different conversations
   share, not as the longest conversation has turns.
3. From the deepest level back, joins by the parent roll up children, leaves
   and savings.

No round collects rows: a group of any size is summed before it is shuffled,
and its members meet it by a join that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.places import numbered
from weftline.functions.prefix import exclusive_prefix
from weftline.llm.common import WORD, cut, named, scratch

#: Ids in one piece of the text that is hashed.
PIECE = 512
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, group: int = 1, most: int = 1, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, d, digest, tokens): the turns of every conversation, from d = 1, and a row of d = 0 for each.

    Turns are ordered by turn, null first; those that tie by the digest of role
    and text. Null roles and texts are empty ones. Rows without a conv_id
    belong to no conversation. Repeated rows are turns each. With group and
    most, conversation c begins with the first h turns of conversation
    c - c % group (all if it has fewer, none if there is no such), h being
    crc32(c) % most, in place of its own first h; by default h is 0. % has the
    sign of c, as in SQL.
    """
    with scratch() as keep:
        return keep(cut(_rebuilt(conversations, group, most, conv_col, turn_col, role_col, text_col)))


def _rebuilt(conversations: DataFrame, group: int, most: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(named(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(named(conv_col).cast("long").alias("conv_id"), named(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    turns = numbered(rows.where("conv_id is not null"), ["conv_id", "turn", "digest"], "g").drop("turn")
    own = cut(turns.groupBy("conv_id").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = own.select(F.col("conv_id").alias("b"), F.col("first").alias("b_first"), F.col("n").alias("b_n"))
    own = own.join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("b"), "left").select("conv_id", "first", h.alias("h"), "b_first", F.least(h, F.coalesce("b_n", F.lit(0))).alias("from_b"))
    own = cut(own)

    tail = own.select(F.col("conv_id").alias("c"), "first", "h", "from_b")
    tail = turns.join(tail, F.col("conv_id") == F.col("c")).where("g - first >= h").select("conv_id", (F.col("g") - F.col("first") - F.col("h") + F.col("from_b") + 1).alias("d"), "digest", "tokens")
    head = own.where("from_b > 0").select("conv_id", "b_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("from_b") - 1)).alias("k"))
    head = head.select("conv_id", (F.col("k") + 1).alias("d"), (F.col("b_first") + F.col("k")).alias("at"))
    head = head.join(turns.select("g", "digest", "tokens"), F.col("at") == F.col("g")).select("conv_id", "d", "digest", "tokens")
    root = own.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("tokens"))
    return root.unionByName(head).unionByName(tail)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (rep, id): pieces of the ids' comma-joined text, at most PIECE ids each."""
    rep, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": [rep], "first": [ids[0]], "text": [",".join(map(str, ids))]})

    for b in batches:
        for r, i in zip(b.column("rep").to_pylist(), b.column("id").to_pylist(), strict=True):
            if ids and (r != rep or len(ids) == PIECE):
                yield piece()
                ids = []
            rep = r
            ids.append(i)
    if ids:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (rep, first): the SHA-256 of each rep's whole text, read as a stream."""
    rep, sha = None, None
    for b in batches:
        for r, text in zip(b.column("rep").to_pylist(), b.column("text").to_pylist(), strict=True):
            if sha is not None and r == rep:
                sha.update(b",")
            else:
                if sha is not None:
                    yield pa.RecordBatch.from_pydict({"r": [rep], "sha": [sha.hexdigest()]})
                rep, sha = r, hashlib.sha256()
            sha.update(text.encode())
    if sha is not None:
        yield pa.RecordBatch.from_pydict({"r": [rep], "sha": [sha.hexdigest()]})


def _classes(turns: DataFrame) -> DataFrame:
    """(rep, mult, length, total, sha) of the classes of conversations with equal turns; sha is that of the members' ids.

    A class is told by its length and two xors of hashes over its places and
    turns, which sum up before a shuffle. SHA-256 has no parts, so a class's
    ids end in one task, but as pieces of 512 that are made where the ids are
    sorted, and only as a stream.
    """
    prints = [F.bit_xor(F.xxhash64(F.lit(k), "d", "digest")).alias(f"f{k}") for k in (1, 2)]
    convs = cut(turns.groupBy("conv_id").agg(F.max("d").alias("length"), F.sum("tokens").alias("total"), *prints))
    key = ["length", "f1", "f2"]
    classes = cut(convs.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.min("total").alias("total")))
    many = classes.where("mult > 1").select(*(F.col(c).alias(f"__{c}") for c in key), "rep")
    ids = convs.join(many, (F.col("length") == F.col("__length")) & (F.col("f1") == F.col("__f1")) & (F.col("f2") == F.col("__f2"))).select("rep", F.col("conv_id").alias("id"))
    pieces = ids.repartitionByRange("rep", "id").sortWithinPartitions("rep", "id").mapInArrow(_pieces, "rep long, first long, text string")
    hashes = pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(_hashes, "r long, sha string")
    sha = F.coalesce("sha", F.sha2(F.col("rep").cast("string").cast("binary"), 256)).alias("sha")
    return cut(classes.join(hashes, F.col("rep") == F.col("r"), "left").select("rep", "mult", "length", "total", sha))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over turns_of(): one row for each distinct sequence of first turns, the empty one included.

    conv_id, the smallest member; depth; parent_conv_id, its parent's (the
    root's is null); n_convs, the members; n_children; n_leaves, the nodes
    without children at or below it; saved_tokens, over it and all below, each
    node's further members times the words of its last turn; ends_sha256, the
    hash of the members that have no further turn. A conversation without
    turns is a member of the root alone. No conversations, no nodes.
    """
    with scratch() as keep:
        classes = keep(_classes(turns))
        count, root, n = classes.agg(F.count(F.lit(1)), F.min("rep"), F.sum("mult")).first()
        if not count:
            return turns.sparkSession.createDataFrame([], NODE)
        names = classes.drop("sha").withColumnRenamed("rep", "r")
        own = cut(turns.where("d > 0").join(names, F.col("conv_id") == F.col("r")).select(F.col("conv_id").alias("rep"), "d", "digest", "tokens", "mult", "length", "total"))

        live = cut(classes.select("rep", "length", "mult", F.lit(root).alias("node")))
        root_node = turns.sparkSession.createDataFrame([(root, None, n, 0)], "conv_id long, parent long, n_convs long, tokens long")
        shared, ends, tops = [root_node], [live.where("length = 0").select(F.col("node").alias("at"), F.col("rep").alias("end"))], []
        depth, rest = 0, own
        while True:
            if depth + 1 & depth == 0:  # the next depth is a power of two: from here on, only what the live classes have up to the next one
                ids = live.select(F.col("rep").alias("r"))
                rest = cut(own.where((F.col("d") > depth) & (F.col("d") < 2 * depth + 2)).join(ids, F.col("rep") == F.col("r"), "left_semi").select("rep", "d", "digest", "tokens"))
            step = live.join(rest.where(F.col("d") == depth + 1).select(F.col("rep").alias("r"), "digest", "tokens"), F.col("rep") == F.col("r"))
            groups = cut(step.groupBy("node", "digest").agg(F.min("rep").alias("conv_id"), F.sum("mult").alias("n_convs"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("tokens")))
            depth += 1
            tops.append(groups.where("n = 1").select(F.col("conv_id").alias("top"), F.lit(depth).cast("long").alias("from_d"), F.col("node").alias("parent")))
            found = groups.where("n > 1").select(F.col("node").alias("parent"), F.col("digest").alias("turn"), "conv_id", "n_convs", "tokens")
            live = cut(step.join(found, (F.col("node") == F.col("parent")) & (F.col("digest") == F.col("turn"))).select("rep", "length", "mult", F.col("conv_id").alias("node")))
            if live.isEmpty():
                break
            shared.append(found.drop("turn"))
            ends.append(live.where(F.col("length") == depth).select(F.col("node").alias("at"), F.col("rep").alias("end")))

        chains = keep(cut(_chains(own, _union(tops))))
        up = chains.where("d = from_d").select("d", "parent", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens")
        below, levels = None, []
        for depth in range(len(shared) - 1, -1, -1):
            children = up.where(F.col("d") == depth + 1).drop("d")
            if below is not None:
                children = children.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
            sums = children.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
            level = shared[depth].join(sums, F.col("conv_id") == F.col("p"), "left").join(ends[depth], F.col("conv_id") == F.col("at"), "left")
            saved = (F.col("n_convs") - 1) * F.col("tokens") + F.coalesce("saved", F.lit(0))
            below = keep(cut(level.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), "end")))
            levels.append(below)

    end = F.when(F.col("d") == F.col("length"), F.col("rep")).alias("end")
    chained = chains.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("from_d"), F.col("parent")).otherwise(F.col("rep")).alias("parent"), F.col("mult").alias("n_convs"), (F.col("d") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", end)
    nodes = chained.unionByName(_union(levels)).join(classes.select(F.col("rep").alias("e"), "sha"), F.col("end") == F.col("e"), "left")
    return nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def _chains(own: DataFrame, tops: DataFrame) -> DataFrame:
    """(rep, d, from_d, parent, mult, length, saved_tokens): the turns of each class from the depth where it is alone."""
    columns = ["rep", "d", "tokens", "mult", "length", "total"]
    copied = exclusive_prefix(own.where("mult > 1").select(*columns), ["rep"], "d", "tokens", "before")
    rows = copied.unionByName(own.where("mult = 1").select(*columns, F.lit(0).cast("long").alias("before")))
    saved = ((F.col("mult") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens")
    return rows.join(tops, F.col("rep") == F.col("top")).where("d >= from_d").select("rep", "d", "from_d", "parent", "mult", "length", saved)
