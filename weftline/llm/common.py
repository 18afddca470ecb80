"""What the corpus operators share: words, hashes and tables that cut lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.tables import carried, cut, named, release, scratch, shared_dir

__all__ = ["SPACE", "WORD", "Recent", "carried", "cut", "named", "paired", "release", "scratch", "shared_dir", "shifted", "table", "words", "worker_state"]

#: Java patterns of white space between words and of a word, over ASCII white space only.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Recent:
    """Values by key in two generations: when the young one is full it becomes the old one, and what is used again is young again.

    most bounds a generation in bytes: those of its keys and values, and OVERHEAD for each entry.
    """

    OVERHEAD = 200

    def __init__(self, most: int):
        self.most, self.used, self.young, self.old = most, 0, {}, {}

    def age(self) -> None:
        if self.used > self.most:
            self.old, self.young, self.used = self.young, {}, 0

    def put(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.used += sum(map(len, keys)) + sum(map(len, values)) + self.OVERHEAD * len(keys)

    def missing(self, keys: set) -> set:
        """Of keys that are not young, those that are not old either; the old ones are young again."""
        known = list(keys & self.old.keys())
        self.put(known, [self.old[k] for k in known])
        return keys.difference(known)


_kept: dict = {}


def worker_state(key: tuple, make: Callable[[], object]) -> object:
    """What make() made for key in this Python worker, so that it outlives a task. A worker keeps one such thing: another key's is let go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; of a null text, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shifted(a: Column, by: int) -> Column:
    """The array without its first elements."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def paired(a: Column, b: Column) -> Column:
    """The hash of a[i] and b[i] for each i that both arrays of longs have."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.xxhash64(x, y))
