"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability in a language is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. The
piece probabilities are fitted by expectation-maximisation, with the backward
algorithm beside, on a bounded sample of labelled documents. Prediction uses
all words of the whole text and nothing else. Words are never cut: the passes
are rescaled as they go, so a run of letters may have any length, as in
scripts without spaces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Recent, named, worker_state

#: What parts words, for Java and for RE2 alike; a word is a run of letters, lower-cased.
NO_LETTERS = r"[^\p{L}]+"
#: Bytes of words and scores that a generation of a worker's memory holds before it ages; the longest word kept, in letters.
CACHE, KEPT = 24 << 20, 32
#: Cells of a lattice that are made at a time, and letters between two rescalings.
CELLS, STEP = 1 << 19, 16
UNKNOWN = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> dict[str, int]:
    """Pieces that are letters only, lower-cased, with '▁' marking a word's start; ids count from 0."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size())})
    good = [p for p in pieces if (p[1:] if p[0] == "▁" else p).isalpha()]
    return {p: i for i, p in enumerate(good)}


@dataclass
class Model:
    """langs in order; logp: piece x language log probabilities, the last row an unknown letter's."""

    langs: list[str]
    vocabulary: dict[str, int]
    logp: np.ndarray
    _p: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._p = np.exp(self.logp).astype(np.float64)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language: words x languages."""
        out = np.empty((len(words), len(self.langs)))
        longest = longest_piece(self.vocabulary)
        for rows in same_length(words, longest):
            out[rows] = forward([words[i] for i in rows], self.vocabulary, self._p, longest)
        return out


def longest_piece(vocabulary: dict[str, int]) -> int:
    return max((len(p) - (p[0] == "▁") for p in vocabulary), default=1)


def same_length(words: list[str], longest: int) -> Iterator[list[int]]:
    """The places of words of one length, as many at a time as CELLS allows."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        many = max(1, CELLS // (n * longest))
        for k in range(0, len(rows), many):
            yield rows[k : k + many]


def lattice(words: list[str], vocabulary: dict[str, int], longest: int, lo: int, hi: int) -> np.ndarray:
    """(words, hi - lo, longest) piece ids of words of one length, -1 without a piece.

    Cell (word, end - lo, size - 1) is the piece of size letters that ends
    after end + 1 letters; an unknown single letter is the piece after the
    last. A piece at the word's beginning has the mark of one.
    """
    get, unknown = vocabulary.get, len(vocabulary)
    flat: list[int] = []
    for w in words:
        marked = "▁" + w[:longest]
        for end in range(lo + 1, hi + 1):
            flat.append(get(w[end - 1 : end] if end > 1 else marked[:2], unknown))
            for size in range(2, min(end, longest) + 1):
                flat.append(get(w[end - size : end] if end > size else marked[: end + 1], -1))
    ids = np.full((len(words), hi - lo, longest), -1, np.int32)
    reach = np.minimum(np.arange(lo + 1, hi + 1), longest)
    ids[:, np.arange(longest) < reach[:, None]] = np.array(flat, np.int32).reshape(len(words), -1)
    return ids


def forward(words: list[str], vocabulary: dict[str, int], p: np.ndarray, longest: int) -> np.ndarray:
    """Log of the summed probability of all segmentations of words of one length: words x languages.

    Only the last longest sums are kept, and divided by the latest one every
    STEP letters, so no sum vanishes however long the words are.
    """
    n = len(words[0])
    logs = np.zeros((len(words), p.shape[1]))
    last = [np.ones_like(logs)]  # sums up to the latest letters, the newest first
    block = max(STEP, CELLS // (len(words) * longest))
    for lo in range(0, n, block):
        ids = lattice(words, vocabulary, longest, lo, min(n, lo + block))
        for k in range(ids.shape[1]):
            total = np.zeros_like(logs)
            for size, before in enumerate(last):
                piece = ids[:, k, size]
                total += before * np.where((piece >= 0)[:, None], p[piece], 0.0)
            last = [total, *last[: longest - 1]]
            if (lo + k) % STEP == STEP - 1:
                last = [x / total for x in last]
                logs += np.log(total)
    return logs + np.log(last[0])


def _log_sums(ids: np.ndarray, logp: np.ndarray, forwards: bool) -> np.ndarray:
    """(letters + 1, words): log of the summed probability of all segmentations up to (or else from) each letter, in one language."""
    n, longest = ids.shape[1:]
    out = np.full((n + 1, len(ids)), -np.inf)
    out[0 if forwards else n] = 0.0
    with np.errstate(divide="ignore"):
        for at in range(1, n + 1) if forwards else range(n - 1, -1, -1):
            reach = min(at if forwards else n - at, longest)
            terms = np.array([out[at - s] + logp[ids[:, at - 1, s - 1]] if forwards else out[at + s] + logp[ids[:, at + s - 1, s - 1]] for s in range(1, reach + 1)])
            top = terms.max(axis=0)
            out[at] = top + np.log(np.exp(terms - top).sum(axis=0))
    return out


def fit_language(words: list[str], weight: np.ndarray, vocabulary: dict[str, int], rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """Log probabilities of the pieces, and of an unknown letter, in one language. Each round replaces them by the expected piece counts, smoothed."""
    pieces, longest = len(vocabulary) + 1, longest_piece(vocabulary)
    batches = [(lattice([words[i] for i in rows], vocabulary, longest, 0, len(words[rows[0]])), weight[rows]) for rows in same_length(words, longest)]
    log_p = np.append(np.full(pieces, -math.log(pieces)), -np.inf)  # the last is that of no piece, -1
    for _ in range(rounds):
        expected = np.full(pieces, smooth)
        for ids, n in batches:
            before, after = _log_sums(ids, log_p, True), _log_sums(ids, log_p, False)
            for size in range(1, min(ids.shape[1:]) + 1):
                piece = ids[:, size - 1 :, size - 1].T  # (ends, words)
                value = np.exp(before[: len(piece)] + log_p[piece] + after[size:] - before[-1]) * n
                has = piece >= 0
                expected += np.bincount(piece[has], value[has], pieces)
        log_p[:-1] = np.log(expected / expected.sum())
    return log_p[:-1]


def sample_words(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int, chars: int) -> DataFrame:
    """(lang, word, n) over about per_lang documents, of about chars code points in all, of each language, chosen by a hash of the id. Of a long text an eighth of chars is taken."""
    text, lang = named(text_col), named(lang_col).cast("string")
    most = max(1, chars // 8)
    known = docs.where(text.isNotNull() & lang.isNotNull()).select(named(id_col).alias("id"), F.make_valid_utf8(text).alias("text"), lang.alias("lang"))
    size = F.least(F.length("text"), F.lit(most))
    chance = F.least(F.lit(1.0), per_lang / F.count(F.lit(1)), chars / F.greatest(F.sum(size), F.lit(1)))
    sizes = known.groupBy(F.col("lang").alias("l")).agg(chance.alias("chance"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.withColumn("draw", draw).join(F.broadcast(sizes), F.col("lang") == F.col("l")).where("draw < chance")  # a row per language, of which the model holds a whole vocabulary
    words = F.explode(F.split(F.lower(F.substring("text", 1, most)), NO_LETTERS)).alias("word")
    return drawn.select("lang", words).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", vocabulary: str | None = None, per_lang: int = 400, rounds: int = 4, chars: int = 8_000_000) -> Model | None:
    """A model of the languages in lang_col, or None without a labelled text (as of an empty table).

    Every language is learnt, in a task of its own, from a bounded sample:
    about per_lang documents of about chars code points in all, and of a text
    of over an eighth of that its beginning. A language whose sample holds no
    letter is not learnt. Only the languages' probabilities reach the driver.
    Rows with a null text or language teach nothing; repeated rows teach each;
    invalid UTF-8 counts as replacement characters; other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def fitted(key: tuple, counts: pa.Table) -> pa.Table:
        words = counts.column("word").to_pylist()
        order = sorted(range(len(words)), key=words.__getitem__)  # sums in one order give one result
        weight = counts.column("n").to_numpy().astype(float)
        log_p = fit_language([words[i] for i in order], weight[order], read_vocabulary(path), rounds)
        return pa.table({"lang": [key[0].as_py()], "logp": [log_p.astype(np.float32).tobytes()]})

    counts = sample_words(docs, text_col, lang_col, id_col, per_lang, chars)
    found = sorted(counts.groupBy("lang").applyInArrow(fitted, "lang string, logp binary").collect())
    if not found:
        return None
    return Model([r["lang"] for r in found], read_vocabulary(path), np.stack([np.frombuffer(r["logp"], np.float32) for r in found], axis=1))


class Scorer:
    """Log probabilities of words, remembered as packed rows."""

    def __init__(self, model: Model):
        self.model, self.known = model, Recent(CACHE)

    def __call__(self, words: list[str]) -> np.ndarray:
        """One row per distinct word."""
        self.known.age()
        young = self.known.young
        found = list(map(young.get, words))
        holes = [i for i, v in enumerate(found) if v is None]
        new = list(self.known.missing({words[i] for i in holes}))
        rows = dict(zip(new, map(np.ndarray.tobytes, self.model.word_scores(new)), strict=True))
        short = [w for w in new if len(w) <= KEPT]
        self.known.put(short, [rows[w] for w in short])
        for i in holes:
            found[i] = rows.get(words[i]) or young[words[i]]
        return np.frombuffer(b"".join(found)).reshape(len(words), len(self.model.langs))


def best_languages(texts: pa.StringArray, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Index of each text's language (the number of languages: none) and its posterior probability."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NO_LETTERS, " ")
    cut_up = pc.ascii_split_whitespace(letters)
    told = cut_up.values.dictionary_encode()
    words = told.dictionary.to_pylist()
    own = np.array([len(w) > 0 for w in words], bool)
    langs = len(scorer.model.langs)
    rows = np.zeros((len(words), langs))
    rows[own] = scorer([w for w in words if w])
    ends = cut_up.offsets.to_numpy()
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    at = told.indices.to_numpy()
    total = np.stack([np.bincount(text, rows[at, k], len(texts)) for k in range(langs)], axis=1)
    some = np.bincount(text, own[at], len(texts)) > 0
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(some, total.argmax(axis=1), langs), np.where(some, score, 0.0)


def predict(text: Column, model: Model | None, group: int = 4 << 20) -> Column:
    """lang (a language of the model; 'und' for a null text or one without a letter) and score.

    The score is the posterior probability of the language with equal priors;
    of 'und' it is 0, as it is for every text without a model. Of languages
    that tie the first by name is taken. Texts of any length are scored whole,
    about group bytes at a time; equal texts get equal results; invalid UTF-8
    counts as replacement characters, which are no letters; an empty table
    gives an empty column. The column counts as nondeterministic, so that no
    filter makes it twice.
    """
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    key = ("language", zlib.crc32(model.logp.tobytes()), tuple(model.langs))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer, langs = worker_state(key, lambda: Scorer(model)), pa.array([*model.langs, UNKNOWN])
        for texts in batches:
            best, score = [np.zeros(0, int)], [np.zeros(0)]
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // group
            for k in np.unique(size):
                lo, hi = np.searchsorted(size, [k, k + 1])
                b, s = best_languages(texts.slice(lo, hi - lo), scorer)
                best.append(b)
                score.append(s)
            yield pa.StructArray.from_arrays([langs.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(score))], ["lang", "score"])

    return F.arrow_udf(run, "struct<lang:string,score:double>").asNondeterministic()(F.make_valid_utf8(text))
