"""Texts cut off by field limits or on their way: length hazards, and the likelihood of an end of text.

The hazard of its length says how likely a text was cut before its ending is looked at; the ending says how much more or
less likely that is. At a significant length an ending that no other text bears out is a cut; elsewhere it takes a context
after which texts are known to go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.grams import batch_codes, rolling_hashes, slices
from wattloom.operators.joins import lookup_join, spread
from wattloom.session import checkpointed

#: Signs of the contexts of an ending. The start of a text is part of a context that is longer than the text.
ORDERS = (12, 8, 5)
#: Bits of the map that tells which contexts can be among those asked for; others aren't counted. 2**24 bits are 2 MB.
MAP_BITS = 24
#: What is read of a text's end: citations behind the last sentence and the longest context, with room.
TAIL = 512

CITATIONS = re.compile(r"(?:\s*\[[A-Z]\d+\])+\s*$")
CUT_MARK = re.compile(r"(?:\.\.\.|…|[\[(<]\s*(?:cut|truncated|trunc|snip|more|continued)\.?\s*[\])>])\s*$", re.I)
CLOSED = re.compile(r"[.!?。！？][\"'»”’)\]*_]*$")


def length_hazards(df: DataFrame, source: str, length: str, reach: int = 20, fdr: float = 0.01, least: int = 5) -> DataFrame:
    """(source, length, n, at_risk, hazard, expected, p_value, significant, excess) of each length that occurs.

    The discrete hazard of a length is the share of texts at least as long that end there. It is tested against that of
    the ``reach`` neighbouring lengths on either side, lengths that don't occur included: ``expected`` is what their
    hazard lets expect of the texts at risk, one text more than they had counted as ended there, but no less than the
    mean count of these lengths up to the source's longest: near the longest text any hazard rises to 1 without a limit.
    Where no text is at risk at any neighbour, all are expected. ``p_value`` bounds the Poisson tail from above (Chernoff). Benjamini and Hochberg's step-up at level ``fdr``
    within each source decides. ``excess`` is the share of the texts of that length beyond what was expected.

    Lengths are counted before anything else, so windows run over lengths, not texts. Null lengths take no part; a null
    source is one of its own.
    """
    counts = df.where(F.col(length).isNotNull()).groupBy(F.col(source).alias("source"), F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n"))
    longer = Window.partitionBy("source").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    by_length = Window.partitionBy("source").orderBy("length")
    around, beyond = by_length.rangeBetween(-reach, reach), by_length.rangeBetween(reach + 1, Window.unboundedFollowing)
    # texts at risk, summed over the lengths from ``first`` to reach beyond: a text counts at each up to its own
    first = F.greatest(F.col("length") - reach, F.lit(0))
    risk = F.col("near_signs") - (first - 1) * F.col("near") + (F.col("length") + reach - first + 1) * F.col("beyond") - F.col("at_risk")
    others = F.least(F.col("length") + reach, F.max("length").over(Window.partitionBy("source"))) - first
    ended = F.col("near") - F.col("n") + 1
    lam = F.when(risk > 0, F.greatest(F.col("at_risk") * ended / risk, ended / others)).otherwise(F.col("at_risk").cast("double"))
    log_p = F.when((F.col("n") > F.col("expected")) & (F.col("n") >= least), -(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected"))).otherwise(0.0)
    tested = (
        counts.withColumns({
            "at_risk": F.sum("n").over(longer), "near": F.sum("n").over(around), "near_signs": F.sum(F.col("n") * F.col("length")).over(around),
            "beyond": F.coalesce(F.sum("n").over(beyond), F.lit(0)),
        })
        .withColumns({"hazard": F.col("n") / F.col("at_risk"), "expected": lam})
        .withColumn("p_value", F.exp(log_p))
    )
    ranked = Window.partitionBy("source").orderBy("p_value", "length")
    whole = Window.partitionBy("source")
    passes = F.col("p_value") <= F.lit(fdr) * F.row_number().over(ranked) / F.count("*").over(whole)
    return (
        tested.withColumn("limit", F.when(passes, F.col("p_value")))
        .withColumn("significant", F.coalesce(F.col("p_value") <= F.max("limit").over(whole), F.lit(False)))
        .withColumn("excess", F.greatest(F.lit(0.0), 1 - F.col("expected") / F.col("n")))
        .drop("near", "near_signs", "beyond", "limit")
    )


def with_excess(rows: DataFrame, source: str, length: str, key: str) -> DataFrame:
    """Rows with the ``excess`` of their length in their source, 0 where it isn't significant; ``key`` spreads hot lengths."""
    limits = length_hazards(rows, source, length).where("significant").select(F.coalesce("source", F.lit("")).alias("_source"), F.col("length").alias("_limit"), "excess")
    keyed = rows.withColumns({"_source": F.coalesce(source, F.lit("")), "_limit": F.col(length).cast("long")})
    return lookup_join(keyed, checkpointed(limits), ["_source", "_limit"], key).drop("_source", "_limit").withColumn("excess", F.coalesce("excess", F.lit(0.0)))


def bare(text: str) -> str:
    """Without the space and the citation tags behind the last sentence."""
    text = text.rstrip()
    return CITATIONS.sub("", text) if text.endswith("]") else text


def is_open(text: str) -> bool:
    """Whether a text ends without closing punctuation and without a mark of the cut."""
    shorn = bare(text)
    return bool(shorn) and not CUT_MARK.search(text) and not CLOSED.search(shorn)


def context_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order a hash of 61 bits of the context that ends at each sign; orders don't share values."""
    return [(h << 2) | i for i, h in enumerate(rolling_hashes(codes, ORDERS, 61))]


def _endings(tails: pd.Series) -> pd.DataFrame:
    texts = tails.fillna("").tolist()
    marks = [CUT_MARK.search(t) for t in texts]
    shorn = [bare(t) for t in texts]
    found = {"c12": [None] * len(texts), "c8": [None] * len(texts), "c5": [None] * len(texts), "whole": [None] * len(texts)}
    asked = [i for i, t in enumerate(shorn) if t and not marks[i] and not CLOSED.search(t)]
    codes, ends = batch_codes([shorn[i] for i in asked], max(ORDERS))
    if asked:
        columns = [h[ends - 1].tolist() for h in context_hashes(codes)] + [(np.diff(np.r_[0, ends]) - max(ORDERS) <= max(ORDERS)).tolist()]
        for name, values in zip(found, columns, strict=True):
            for i, v in zip(asked, values, strict=True):
                found[name][i] = v
    marked = [bool(m) and any(c.isalnum() for c in t[: m.start()]) for m, t in zip(marks, texts, strict=True)]
    return pd.DataFrame({**{k: pd.array(v, dtype="boolean" if k == "whole" else "Int64") for k, v in found.items()}, "marked": marked}, index=tails.index)


def endings(text: Column | str) -> Column:
    """How a text ends: whether a mark of the cut stands there, and, if it's left open, the contexts of its end.

    Closed punctuation, with citations behind it or not, is no open end; the contexts are null then, as for null and empty texts.
    """
    read = F.pandas_udf(_endings, "struct<c12: bigint, c8: bigint, c5: bigint, whole: boolean, marked: boolean>")
    return read(F.right(F.col(text) if isinstance(text, str) else text, F.lit(TAIL)))


def context_counts(df: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """(context, seen, ends): how often each of the ``asked`` contexts occurs in all texts, and how often a text or line ends there.

    Counts are exact. A map of bits of fixed size keeps contexts that nobody asked for from being counted; the few that
    pass it by chance find no one to join. Each task adds up its batches, and Spark adds these.
    """
    mask = (1 << MAP_BITS) - 1
    bit = F.shiftright("context", 2).bitwiseAND(F.lit(mask))
    words = asked.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast((shiftright(context, 2) & {mask}) & 63 as int))").alias("bit"))
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    bits[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def added(context: np.ndarray, seen: np.ndarray | None, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where, several = pd.factorize(context)
        total = lambda x: np.bincount(where, weights=x, minlength=len(several)).astype(np.int64)
        return several, total(seen), total(ends)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for part in slices(texts):
                codes, ends = batch_codes([bare(t) for t in texts[part]], max(ORDERS))
                inside = codes != 2
                stop = np.zeros(len(codes), dtype=bool)
                stop[ends[ends > 0] - 1] = True
                stop[:-1] |= codes[1:] == 10
                hits = []
                for h in context_hashes(codes):
                    at = (h >> 2) & mask
                    hits.append(np.flatnonzero(inside & (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                    hits[-1] = h[hits[-1]], stop[hits[-1]]
                found.append(added(np.concatenate([h for h, _ in hits]), None, np.concatenate([e for _, e in hits])))
            if found:
                context, seen, ends_ = added(*[np.concatenate(x) for x in zip(*found, strict=True)])
                yield pd.DataFrame({"context": context, "seen": seen, "ends": ends_})

    texts = spread(df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")))
    return texts.mapInPandas(count, "context bigint, seen bigint, ends bigint").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def end_probabilities(df: DataFrame, text: str, unseen: float, weight: float = 4.0, whole_unseen: float = 0.5) -> DataFrame:
    """(c12, p_end): for each context of an open ending, the probability that a text ends there.

    The share of the ends among a context's other occurrences in all texts, smoothed by that of the shorter contexts, as if
    these were ``weight`` more occurrences, and last by ``unseen``. A text that lies whole within its context is only held
    against the beginnings of others, smoothed by ``whole_unseen``: with nothing that begins with it, it may well be complete.
    """
    asked = checkpointed(df.select(endings(text).alias("e")).where("e.c12 is not null").select("e.c12", "e.c8", "e.c5", "e.whole").dropDuplicates(["c12"]))
    every = asked.select(F.explode(F.array("c12", "c8", "c5")).alias("context")).distinct()
    counts = checkpointed(context_counts(df, text, every))
    out = asked
    for c in ("c5", "c8", "c12"):
        side = counts.select(F.col("context").alias(c), F.greatest(F.col("seen") - 1, F.lit(0)).alias(f"n_{c}"), F.greatest(F.col("ends") - 1, F.lit(0)).alias(f"e_{c}"))
        out = lookup_join(out, side, [c], "c12", 48)
    smoothed = lambda c, p: (F.coalesce(F.least(f"e_{c}", f"n_{c}"), F.lit(0)) + weight * p) / (F.coalesce(F.col(f"n_{c}"), F.lit(0)) + weight)
    general = smoothed("c12", smoothed("c8", smoothed("c5", F.lit(unseen))))
    return out.select("c12", F.when(F.col("whole"), smoothed("c12", F.lit(whole_unseen))).otherwise(general).alias("p_end"))


def with_cuts(rows: DataFrame, text: str, source: str, key: str, rare: float = 0.005, elsewhere: float = 0.5, surest: float = 0.98) -> DataFrame:
    """``rows`` with ``cut``, whether the text stops inside a word or sentence, and ``at_limit``, where most of its length do.

    A mark of the cut decides at once, and so does closed punctuation. For an open ending, the odds of a cut before it is
    looked at are those of the excess of its length's hazard (``surest`` at most), or ``elsewhere`` at lengths without one.
    They are multiplied by ``rare`` / p_end, where ``rare`` is the end probability at which an ending tells nothing. So an
    ending of which nothing is known is a cut at a significant length and none elsewhere.

    Null and empty texts aren't cut; repeated rows each get a row; an empty table gives none. ``key`` spreads hot lengths
    and endings over tasks where the tables of limits or endings are too large to be sent to all of them.
    """
    prior = checkpointed(end_probabilities(rows, text, rare))
    seen = with_excess(rows.withColumn("_length", F.length(text).cast("long")), source, "_length", key).withColumn("_e", endings(text))
    keyed = seen.withColumns({"c12": F.col("_e.c12"), "_marked": F.col("_e.marked")}).drop("_e")
    judged = lookup_join(keyed, prior, ["c12"], key, 24)
    x = F.least("excess", F.lit(surest))
    odds = F.greatest(x / (1 - x), F.lit(elsewhere)) * rare / F.col("p_end")
    return judged.withColumns({"cut": F.coalesce(F.col("_marked"), F.lit(False)) | F.coalesce(odds > 1, F.lit(False)), "at_limit": F.col("excess") > 0.5}).drop("c12", "_marked", "p_end", "excess", "_length")
