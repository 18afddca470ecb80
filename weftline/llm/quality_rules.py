"""Host-level quality rules.

Documents are measured by plain rules; failures are counted per host, and the
hosts' failure rates are shrunk with a beta prior fitted to all hosts. A host
of whose documents most surely break some rule loses all its documents. A host
that surely breaks a rule more often than the corpus does is suspect under it,
and loses the documents that break it; elsewhere the soft rules alone condemn
nothing. Surely means by DEVIATIONS standard deviations of the host's
posterior, so small hosts need no floor. Everything is DataFrame expressions;
the only shuffle moves one partial count per host and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WORD, cut, named, paired, shifted, words

#: Length in words of the windows whose repetition counts.
WINDOW = 8
#: Standard deviations of its posterior by which a host's rate must be over a bound.
DEVIATIONS = 1.5
#: Rules that a document must meet whatever its host is; the others need a suspect host.
BASE = ("short", "repeated")


def repeated_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Add out: how many words stand in a window of WINDOW words found twice or more in the text.

    A window's hash doubles up from its words' hashes (1, 2, 4, 8 words), so
    each is made in constant time. Only texts with an equal pair of hashes
    are sorted to find the places.
    """
    h, g, s, p = (f"__{out}_{x}" for x in "hgsp")
    df = df.withColumn(h, F.transform(words_col, lambda w: F.xxhash64(w)))
    span = 1
    while span < WINDOW:
        df = df.withColumn(h, paired(F.col(h), shifted(F.col(h), span)))
        span *= 2
    df = df.withColumnRenamed(h, g).drop(h)
    place = "struct<h:bigint,i:int>"
    twice = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn(s, F.when(twice, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    before = F.concat(F.array(F.lit(None).cast(place)), F.col(s))
    after = F.slice(F.col(s), F.lit(2), F.size(s))
    same = F.zip_with(s, before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("e")))
    both = F.zip_with(same, after, lambda a, b: F.struct(a["i"].alias("i"), (a["e"] | F.coalesce(a["h"] == b["h"], F.lit(False))).alias("e")))
    places = F.sort_array(F.transform(F.filter(both, lambda x: x["e"] & x["i"].isNotNull()), lambda x: x["i"]))
    df = df.withColumn(p, F.when(F.col(s).isNotNull(), places))
    steps = F.zip_with(p, F.slice(F.col(p), F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(g, s, p)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host and the counts that the rules use.

    A null or empty text has no words and no symbols; a long one is measured
    whole; invalid UTF-8 is taken as it is. Other columns of docs are not
    carried, so no name can clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(named(id_col).alias("doc_id"), named(host_col).alias("host"), named(text_col).alias("text"))
    df = df.select("doc_id", "host", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        "doc_id",
        "host",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    return repeated_words(df, "w", "n_repeat_words").drop("w")




def rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repeated": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, names: list[str], max_rate: float, deviations: float) -> DataFrame:
    """Per host: its worst shrunk failure rate, whether it is rejected, and under which rules it is suspect.

    A rule's beta prior has the hosts' pooled rate as its mean; its strength
    comes from the variance between hosts beyond what chance within hosts
    makes (method of moments). Where there is none, the prior is a point:
    every host has the pooled rate and none is suspect. Only one row of sums
    comes to the driver.
    """
    hosts = cut(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"f_{r}") for r in names)))
    total = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *(F.sum(f"f_{r}").alias(f"f_{r}") for r in names), *(F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}") for r in names)).first()
    rates, over, suspect = [], [], []
    for r in names:
        n, mean = total["n"] or 1, (total[f"f_{r}"] or 0) / (total["n"] or 1)
        chance = mean * (1 - mean)
        between = (total[f"q_{r}"] or 0) / n - mean * mean - chance * total["hosts"] / n
        if between > 1e-12:
            strength = chance / between - 1
            weight = F.col("n") + strength
            rate = (F.col(f"f_{r}") + mean * strength) / weight
            low = F.round(rate - deviations * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (weight + 1)), 6)
        else:
            rate = low = F.lit(mean)
        rates.append(F.round(rate, 6))
        over.append(low > max_rate)
        suspect.append((low > mean if between > 1e-12 else F.lit(False)).alias(f"suspect_{r}"))
    rejected = over[0]
    for x in over[1:]:
        rejected |= x
    return hosts.select("host", F.greatest(*rates).alias("host_rate"), rejected.alias("host_rejected"), *suspect)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, deviations: float = DEVIATIONS) -> DataFrame:
    """Measures and verdicts, a row per row of docs.

    base_failed: the document itself breaks a base rule (short, repeated).
    host_rejected: its host's rate of some rule is surely over max_rate.
    host_failed: it breaks a rule under which its host is suspect. kept: none
    of these. Null hosts form one host; repeated rows count each; hosts that
    tie in their counts fare alike; an empty table gives an empty result.
    """
    checks = rules()
    measured = measures(docs, id_col, text_col, host_col)
    measured = cut(measured.select("*", *(c.alias(f"fails_{r}") for r, c in checks.items())))
    verdict = cut(host_verdicts(measured, list(checks), max_rate, deviations).withColumnRenamed("host", "__host"))
    out = measured.join(verdict, F.col("host").eqNullSafe(F.col("__host")), "left")
    base, failed = F.lit(False), F.lit(False)
    for r in checks:
        base = base | F.col(f"fails_{r}") if r in BASE else base
        failed |= F.col(f"fails_{r}") & F.col(f"suspect_{r}")
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "host_rate", "host_rejected", failed.alias("host_failed"), (~base & ~F.col("host_rejected") & ~failed).alias("kept"),
    )
