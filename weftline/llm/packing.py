"""Mixture-controlled packing of documents into training sequences.

1. Documents are tokenised once; the compressed ids form a table in the shared
   folder. Its token totals per source give the target proportions, unless
   weights are given.
2. Documents are dealt by hash into shards of about shard_tokens tokens, so a
   shard holds a random share of every source. The hash covers the row's
   place in the table, so equal rows part. Within a shard, a document's second
   copy comes in a second round over the shard, in another order, and so on:
   no copy lies by its twin.
3. Within a shard, deficit round-robin over one queue per source fills window
   after window: every source is credited its share of the window, and a
   source with credit serves a piece of its first document. Overdrafts and
   left credit go on to the next window, and from shard to shard: what a shard
   leaves is known from token totals alone (share x tokens packed - tokens
   served), so a prefix sum over shards hands every shard its opening
   deficits and the shards run in parallel. The sum runs over ranges of LANE
   shards and over the ranges' totals, so it is whole and no task holds more.
4. A shard's last tokens fill sequences of falling powers of two, without
   padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.prefix import exclusive_prefix
from weftline.llm.common import Recent, cut, named, worker_state

#: Bytes of chunks and ids that a generation of a worker's memory holds before it ages; the longest chunk kept, in bytes.
CACHE, CHUNK = 24 << 20, 64
#: Bytes of text that are tokenised at a time.
BATCH = 4 << 20
LANE = 1024

PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters that lower-casing and composition leave alone, and marks that are tokens' runs of their own behind one.
_PLAIN = "a-zà-öø-ÿ"
_MARKED = rf"([{_PLAIN}])([.,!?;:$%&*#]+)([ \t\n\r])"
_WORD = re.compile(rf"[{_PLAIN}]+")


class Encoder:
    """Token ids of texts, by chunks.

    The tokenizer drops white space, no token crosses it, and a run of letters
    and a run of marks are never one token. So texts are cut at ASCII white
    space (which every form of the tokenizer's white space includes) and
    before marks that end a word; a text's ids are its chunks' ids in order,
    and chunks that come again are looked up. New chunks of plain letters are
    encoded many at a time by a copy of the tokenizer without the steps that
    leave them alone. What a tokenizer does is probed first: cuts and copies
    that would change its ids are not used.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Recent(CACHE)
        one = lambda *texts: [x.tobytes() for x in self._encoded(list(texts))]
        self.folds = one("Ab", "THE", "X") == one("ab", "the", "x")
        self.splits = one("ab,", "é.", "q$$$", "the!!") == [x + y for x, y in zip(one("ab", "é", "q", "the"), one(",", ".", "$$$", "!!"), strict=True)]
        self.plain, self.ends = None, np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and self.ends.any():
            steps[0] = {"type": "WhitespaceSplit"}
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
            probe = ["the", "a", "thtionéa", "àöøÿ", "zzzzqx", "été", "straße"]
            if [x.tobytes() for x in self._plain_words(probe)] != one(*probe):
                self.plain = None

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _plain_words(self, words: list[str], group: int = 512) -> list[np.ndarray]:
        """The ids of words of plain letters. Every word ends with the one token that ends words."""
        out: list[np.ndarray] = []
        for e in self.plain.encode_batch_fast([" ".join(words[k : k + group]) for k in range(0, len(words), group)], add_special_tokens=False) if words else []:
            ids = np.array(e.ids, self.dtype)
            out += np.split(ids, np.flatnonzero(self.ends[ids])[:-1] + 1)
        if len(out) != len(words):
            raise ValueError("the tokenizer's word ends do not match the words")
        return out

    def values(self, chunks: list[bytes]) -> list[bytes]:
        """The packed ids of distinct chunks."""
        self.known.age()
        young = self.known.young
        found = list(map(young.get, chunks))
        holes = [i for i, v in enumerate(found) if v is None]
        new = self.known.missing({chunks[i] for i in holes})
        plain, other = [], []
        for c in new:
            word = c.decode("utf-8", "replace")
            (plain if self.plain is not None and _WORD.fullmatch(word) else other).append((c, word))
        fresh: dict[bytes, bytes] = {}
        for part, encode in ((plain, self._plain_words), (other, self._encoded)):
            fresh.update(zip([c for c, _ in part], [x.tobytes() for x in encode([w for _, w in part])], strict=True))
        short = [c for c in fresh if len(c) <= CHUNK]
        self.known.put(short, [fresh[c] for c in short])
        for i in holes:
            found[i] = fresh[chunks[i]] if chunks[i] in fresh else young[chunks[i]]
        return found

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text; of a null one, none. Chunks are cut, told apart and put together again in arrays."""
        texts = pc.fill_null(texts, "")
        special = pc.any(pc.match_substring(texts, "<|")).as_py()  # maybe special tokens: as they are
        if self.folds and not special:
            texts = pc.ascii_lower(texts)
        if self.splits and not special:
            texts = pc.replace_substring_regex(texts, _MARKED, r"\1 \2\3")
        cut_up = pc.ascii_split_whitespace(texts)
        told = cut_up.values.dictionary_encode()
        chunks = told.dictionary.cast(pa.binary()).to_pylist()
        values = self.values([c for c in chunks if c])
        if b"" in chunks:
            values.insert(chunks.index(b""), b"")
        ids = np.frombuffer(b"".join(values), self.dtype)
        size = np.array([len(v) for v in values], np.int64) // self.dtype.itemsize
        start = np.cumsum(size) - size
        at = told.indices.to_numpy()
        n = size[at]
        before = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat((start[at] - before[:-1]).astype(np.int32), n) + np.arange(before[-1], dtype=np.int32)]
        return np.split(out, before[cut_up.offsets.to_numpy()[1:-1]])


def _tokenised(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = worker_state(("packing", path), lambda: Encoder(path)), zstandard.ZstdCompressor(level=1)
        last = np.array([end], encode.dtype)

        def out(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.append(x, last) for x in encode(part.column("text"))]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack.compress(x.tobytes()) for x in ids], pa.binary())], ["doc_id", "source", "tokens", "ids"])

        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)) // BATCH
            for k in np.unique(size):
                lo, hi = np.searchsorted(size, [k, k + 1])
                yield out(b.slice(lo, hi - lo))

    return run


def windows(total: int, length: int) -> Iterator[int]:
    """Window sizes that sum up to total: full windows, then falling powers of two."""
    yield from (length for _ in range(total // length))
    rest = total % length
    while rest:
        yield (size := 1 << (rest.bit_length() - 1))
        rest -= size


def round_robin(queues: dict, share: dict, deficit: dict, length: int, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) that fill every window.

    queues: source -> deque of (document, tokens). deficit: source -> what it
    is owed; changed in place. A piece has least tokens or more where the
    document and the window allow.
    """
    ring = deque(sorted(queues, key=lambda s: (s is None, s)))
    at = dict.fromkeys(ring, 0)
    for w, space in enumerate(windows(sum(t for q in queues.values() for _, t in q), length)):
        for s in deficit:
            deficit[s] += share[s] * space
        offset = 0
        while offset < space:
            for _ in range(len(ring)):
                if deficit[ring[0]] > 0:
                    break
                ring.rotate(-1)
            else:  # only sources whose queues are empty have credit
                ring.rotate(-max(range(len(ring)), key=lambda k: deficit[ring[k]]))
            s = ring[0]
            doc, tokens = queues[s][0]
            left = tokens - at[s]
            n = min(left, space - offset, max(least, int(deficit[s])))
            if 0 < left - n < least:
                n = min(left, space - offset)
            yield doc, at[s], n, w, offset
            offset += n
            deficit[s] -= n
            at[s] += n
            if at[s] == tokens:
                queues[s].popleft()
                at[s] = 0
            if queues[s]:
                ring.rotate(-1)
            else:
                ring.popleft()


def rounds(ids: list, order: list[int]) -> list[int]:
    """The places of rows in their order: the first rows of all ids, then their second ones in another order, and so on."""
    seen: dict = {}
    keys = []
    for i in sorted(range(len(ids)), key=order.__getitem__):
        turn = seen.get(ids[i], 0)
        seen[ids[i]] = turn + 1
        keys.append((turn, order[i] * (2 * turn + 1) % (1 << 64), i))
    return [i for _, _, i in sorted(keys)]


def _packed(length: int, least: int, wide: int):
    schema = pa.schema([(c, pa.string() if c == "source" else pa.int64()) for c in ("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(docs: pa.Table, plan: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = docs.take(pa.array(rounds(docs.column("doc_id").to_pylist(), docs.column("order").to_pylist())))
        shard = docs.column("shard")[0].as_py()
        share = dict(zip(plan.column("source").to_pylist(), plan.column("share").to_pylist(), strict=True))
        deficit = dict(zip(plan.column("source").to_pylist(), plan.column("carry").to_pylist(), strict=True))
        ids, sources, tokens = (docs.column(c).to_pylist() for c in ("doc_id", "source", "tokens"))
        unpack = zstandard.ZstdDecompressor()
        kind = np.dtype(f"<u{wide}")
        blobs = docs.column("ids").to_pylist()
        queues: dict = {}
        for i, s in enumerate(sources):
            queues.setdefault(s, deque()).append((i, tokens[i]))
        rows, held = [], {}
        for i, start, n, w, offset in round_robin(queues, share, deficit, length, least):
            if i not in held:
                held[i] = np.frombuffer(unpack.decompress(blobs[i]), kind).astype("<u4")
            crc = zlib.crc32(held[i][start : start + n].tobytes())
            if start + n == tokens[i]:
                del held[i]
            rows.append((ids[i], sources[i], start, n, crc, tokens[i], shard << 32 | w, offset))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, tokenizer: str | None = None, length: int = 4096, end: int = 2, shard_tokens: int = 1 << 20, least: int = 256) -> DataFrame:
    """One row per piece of a document in a sequence: PIECES.

    weights (source, weight): target proportions of tokens; without, the
    corpus' own. A source that weights lack has proportion 0 and is served
    when no other source has tokens left to serve. Every id of every document
    lies in exactly one piece; a null or empty text is the end token alone; a
    long one is cut into as many pieces as it takes. Repeated rows are packed
    each, a null id is one like any other, and null sources form one queue.
    Rows that tie in the order of a shard go by their place. Invalid UTF-8
    counts as replacement characters. An empty table gives no pieces. Other
    columns of docs are not read, so no name can clash. length is a power of
    two.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    path = tokenizer or default_tokenizer()
    from tokenizers import Tokenizer

    wide = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(named(source_col).cast("string")).alias("source"), F.make_valid_utf8(named(text_col)).alias("text"))
    ids = cut(docs.mapInArrow(_tokenised(path, end), "doc_id long, source string, tokens long, ids binary").withColumn("place", F.monotonically_increasing_id()))
    total = ids.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    order = F.xxhash64("doc_id", "source", "place")
    dealt = ids.select("*", order.alias("order"), F.pmod(order, F.lit(shards)).alias("shard")).drop("place")
    served = cut(dealt.groupBy("shard", "source").agg(F.sum("tokens").alias("served")))
    if weights is None:
        shares = served.groupBy("source").agg((F.sum("served") / total).alias("share"))
    else:
        known = served.select(F.col("source").alias("__s")).distinct()
        used = weights.select("source", F.col("weight").cast("double").alias("weight")).join(known, F.col("source").eqNullSafe(F.col("__s")))
        norm = used.agg(F.sum("weight")).first()[0] or 1.0
        shares = used.select("source", (F.col("weight") / norm).alias("share"))
    shares = shares.select(F.col("source").alias("__s"), "share")
    sizes = exclusive_prefix(served.groupBy("shard").agg(F.sum("served").alias("size")), [], "shard", "size", "before", LANE)
    sizes = sizes.select(F.col("shard").alias("__shard"), "before")
    plan = exclusive_prefix(served, ["source"], "shard", "served", "done", LANE)
    plan = plan.join(sizes, F.col("shard") == F.col("__shard")).join(shares, F.col("source").eqNullSafe(F.col("__s")), "left")
    share = F.coalesce("share", F.lit(0.0))
    plan = cut(plan.select("shard", "source", share.alias("share"), (share * F.col("before") - F.col("done")).alias("carry")))
    return dealt.groupBy("shard").cogroup(plan.groupBy("shard")).applyInArrow(_packed(length, least, wide), PIECES)


def sequences(pieces: DataFrame, length: int = 4096) -> DataFrame:
    """(sequence_id, tokens, padding) of packed sequences; lengths that are powers of two need no padding."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    whole = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return used.select("sequence_id", "tokens", F.when(whole, 0).otherwise(length - F.col("tokens")).cast("long").alias("padding"))
