"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of alpha, normalised.
alpha is bisected between 0 (equal weights) and 1 (natural shares): the
largest that reaches a target entropy, then, if a source would be repeated
more than allowed, the least above it that keeps the limit. Weights times the
budget give each source a quota of tokens, realised as whole epochs and the
beginning of one more. An epoch is a permutation of blocks and, in a block, of
documents, both by hash, so no source is ever sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, carried, cut, named

#: alpha is found on a grid of 2 ** -BITS; LEVELS levels of bisection are taken in one pass.
BITS, LEVELS = 24, 6


@dataclass(frozen=True)
class Target:
    """What alpha has to meet, and how many tokens to take.

    entropy: as a share of the logarithm of the number of sources, or None.
    repeats: the most often a token may be taken, or None. budget: tokens;
    passes: the same as a multiple of the corpus' tokens; without both, as
    many as let every source be used whole once.
    """

    entropy: float | None = 0.95
    repeats: float | None = None
    budget: int | None = None
    passes: float | None = None


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordered(*parts: Column) -> Column:
    """A hash as 16 hexadecimal digits, the same in any engine."""
    return F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def block_key(source: Column, block: Column, seed: int) -> Column:
    return _ordered(F.lit(f"block{seed}"), source, block.cast("string"))


def doc_key(name: Column, seed: int) -> Column:
    return _ordered(F.lit(f"doc{seed}"), name)


def block_of(name: Column, blocks: int, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(f"deal{seed}"), name).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % blocks


def _bisect(sources: DataFrame, searches: list[tuple[Callable[[dict], bool], bool]]) -> list[float]:
    """For each search (good, largest), the end of the range of alphas in [0, 1] for which good(moments) holds, on the grid.

    largest: good holds up to some alpha and that is sought; else from some
    alpha on. LEVELS levels of bisection of all searches are one aggregation
    of the sources, of which only sums come to the driver.
    """
    top = 1 << BITS
    ends = [top if largest else 0 for _, largest in searches]
    ranges = [[end, end] if good(m) else [0, top] for (good, _), end, m in zip(searches, ends, _moments(sources, [e / top for e in ends]), strict=True)]
    while any(hi - lo > 1 for lo, hi in ranges):
        grids = [list(range(lo + max(1, (hi - lo) >> LEVELS), hi, max(1, (hi - lo) >> LEVELS))) for lo, hi in ranges]
        found = iter(_moments(sources, [k / top for grid in grids for k in grid]))
        for (good, largest), grid, own in zip(searches, grids, ranges, strict=True):
            for k, holds in [(k, good(next(found))) for k in grid]:
                if holds == largest:
                    own[0] = k
                else:
                    own[1] = k
                    break
    return [(lo if largest else hi) / top for (_, largest), (lo, hi) in zip(searches, ranges, strict=True)]


def _moments(sources: DataFrame, alphas: list[float]) -> list[dict]:
    """For each alpha: z (sum of p ** alpha), h (entropy of the weights), top (largest weight by share), least (least weight by share)."""
    every = sources.select("p", F.posexplode(F.array(*map(F.lit, alphas))).alias("k", "alpha"))
    power = F.exp(F.col("alpha") * F.log("p"))
    every = every.select("k", "alpha", "p", power.alias("w"))
    sums = every.groupBy("k", "alpha").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("p")).alias("e"), F.max(F.col("w") / F.col("p")).alias("top"), F.min(F.col("w") / F.col("p")).alias("least"))
    return [{"alpha": r["alpha"], "z": r["z"], "h": math.log(r["z"]) - r["alpha"] * r["e"] / r["z"], "top": r["top"] / r["z"], "least": r["least"] / r["z"]} for r in sorted(sums.collect())]


def _name(doc_id: Column, text: Column) -> Column:
    """What a row is dealt and ordered by: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def plan(docs: DataFrame, target: Target, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents' tokens (doc_id, name, source, n_tokens, block), the plan per source, and the number of blocks.

    The plan: p, weight, epochs, and the block and document keys up to which
    one more epoch is taken (null: not begun).
    """
    base = cut(docs.select(named(id_col).alias("doc_id"), _name(named(id_col), named(text_col)).alias("name"), F.coalesce(F.concat(F.lit("="), named(source_col)), F.lit("")).alias("source"), token_count(named(text_col)).alias("n_tokens")))
    rows = base.count()
    blocks = max(1, round(rows**0.5))
    base = base.withColumn("block", block_of(F.col("name"), blocks, seed))
    dealt = cut(base.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    sources = dealt.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total, n = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = total or 0
    sources = sources.select("source", "tokens", (F.col("tokens") / max(total, 1)).alias("p"))
    if total:
        passes = target.budget / total if target.budget is not None else target.passes
        searches = []
        if target.entropy is not None:
            searches.append((lambda m: m["h"] >= target.entropy * math.log(n) - 1e-12, True))
        if target.repeats is not None:
            searches.append((lambda m: (passes if passes is not None else 1 / m["least"]) * m["top"] <= target.repeats + 1e-12, False))
        alpha = max(_bisect(sources, searches)) if searches else 1.0
        m = _moments(sources, [alpha])[0]
        budget = total / m["least"] if passes is None else target.budget if target.budget is not None else passes * total
        weight_of = F.exp(F.lit(alpha) * F.log("p")) / F.lit(m["z"])
    else:
        budget, weight_of = 0, F.lit(0.0)
    quota = F.floor(F.round(weight_of * budget, 3)).cast("long")
    plans = sources.select("source", "tokens", weight_of.alias("weight"), quota.alias("quota"))
    plans = plans.select("*", F.floor(F.col("quota") / F.col("tokens")).alias("epochs"))
    plans = plans.select("*", (F.col("quota") - F.col("epochs") * F.col("tokens")).alias("rest"))

    inner = dealt.withColumn("bkey", block_key(F.col("source"), F.col("block"), seed))
    order = Window.partitionBy("source").orderBy("bkey", "block")
    inner = inner.select("source", "block", "bkey", "tokens", F.sum("tokens").over(order).alias("upto"))
    own = plans.select(F.col("source").alias("__s"), "rest")
    edge = inner.join(own, F.col("source") == F.col("__s")).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")))
    edge = edge.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "bkey", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))
    last = base.join(edge, (F.col("source") == F.col("__s")) & (F.col("block") == F.col("__b"))).withColumn("dkey", doc_key(F.col("name"), seed)).groupBy("source", "dkey", "room").agg(F.sum("n_tokens").alias("n_tokens"))
    within = last.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("dkey"))).where("upto <= room")
    stop = within.groupBy("source").agg(F.max("dkey").alias("stop")).withColumnRenamed("source", "__d")
    cuts = edge.join(stop, F.col("__s") == F.col("__d"), "left").select(F.col("__s").alias("__e"), F.col("bkey").alias("cut_block"), F.col("stop").alias("cut_doc"))
    plans = cut(plans.join(cuts, F.col("source") == F.col("__e"), "left").select(F.col("source").alias("__source"), "weight", "epochs", "cut_block", "cut_doc"))
    return base, plans, blocks


def _taken(keyed: DataFrame, plans: DataFrame) -> DataFrame:
    """keyed (with __src, __bkey, __dkey) joined with the plan, and how often each row is taken as copies."""
    more = (F.col("__bkey") < F.col("cut_block")) | ((F.col("__bkey") == F.col("cut_block")) & (F.col("__dkey") <= F.col("cut_doc")))
    joined = keyed.join(plans, F.col("__src") == F.col("__source"), "left")
    return joined.withColumn("copies", F.coalesce(F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(0)).cast("long"))


def _keyed(df: DataFrame, name: Column, source: Column, blocks: int, seed: int) -> DataFrame:
    df = df.withColumn("__src", source).withColumn("__block", block_of(name, blocks, seed))
    return df.withColumn("__bkey", block_key(F.col("__src"), F.col("__block"), seed)).withColumn("__dkey", doc_key(name, seed))


def mixture(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, weight, copies, block_key, doc_key) for each row of docs.

    An epoch's order is block_key, doc_key; copies counts the epochs that take
    the row. The quota of a source is met from below, within the tokens of one
    document (of all rows with one id, which tie and fare alike). Null sources
    form one source; a source without tokens has weight 0 and no copies; a row
    without an id goes by its text. Long texts are counted whole; an empty
    table gives an empty one. Other columns are not read.
    """
    base, plans, blocks = plan(docs, target, id_col, text_col, source_col, seed)
    out = _taken(_keyed(base, F.col("name"), F.col("source"), blocks, seed), plans)
    source = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30))
    return out.select("doc_id", source.alias("source"), "n_tokens", F.coalesce(F.round("weight", 6), F.lit(0.0)).alias("weight"), "copies", F.col("__bkey").alias("block_key"), F.col("__dkey").alias("doc_key"))


def apply_mixture(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, epoch_col: str | None = None) -> DataFrame:
    """docs with each row as often as the mixture takes it; all columns stay. epoch_col: a column to add that numbers a row's epochs from 1."""
    _, plans, blocks = plan(docs, target, id_col, text_col, source_col, seed)
    source = F.coalesce(F.concat(F.lit("="), named(source_col)), F.lit(""))
    rows = docs.select(carried(docs), _name(named(id_col), named(text_col)).alias("__name"), source.alias("__from"))
    taken = _taken(_keyed(rows, F.col("__name"), F.col("__from"), blocks, seed), plans).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *([F.col("epoch").alias(epoch_col)] if epoch_col else []))
