"""Language posteriors from a naive Bayes model over character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.grams import batch_codes, rolling_hashes, slices

ORDERS, BITS = (1, 2, 3, 4), 16
CODE = re.compile(r"\b[^\W\d]*\d\w*")
NO_LETTER = re.compile(r"[\W\d_]+")


def _letters(texts: Sequence[str]) -> list[str]:
    """Words in lower case; numbers, and codes that have digits in them, belong to no language."""
    return [NO_LETTER.sub(" ", CODE.sub(" ", t.casefold())).strip() for t in texts]


@dataclass
class LanguageModel:
    languages: tuple[str, ...]
    #: (orders, buckets, languages): log likelihood of a gram
    log_p: np.ndarray

    def log_likelihood(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, languages); 0 for a text without letters. Even priors make differences the log posterior odds."""
        texts = [f" {t} " if t else "" for t in _letters(texts)]
        codes, ends = batch_codes(texts, max(ORDERS))
        hashes = rolling_hashes(codes, ORDERS, BITS)
        score = self.log_p[0].take(hashes[0], axis=0)
        for table, h in zip(self.log_p[1:], hashes[1:], strict=True):
            score += table.take(h, axis=0)
        score[codes == 2] = 0
        starts = np.r_[0, ends[:-1]]
        # by columns, which reduceat adds up far faster than rows
        sums = [np.add.reduceat(np.ascontiguousarray(score[:, i]), starts) for i in range(len(self.languages))] if len(texts) else []
        return np.stack(sums, axis=1).astype(float) / len(ORDERS) if sums else np.zeros((len(texts), len(self.languages)))


def language_code(lang: Column | str) -> Column:
    """The first two letters of a label in lower case; null where it doesn't begin with two letters."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(code.rlike("^[a-z]{2}$"), code)


def train_languages(labelled: DataFrame, text: str, lang: str, key: str, per_language: int = 400, least_share: float = 0.02) -> LanguageModel:
    """Fit on ``per_language`` labelled rows of each language at most, in the order of a hash of their key.

    The languages are those of the labels that ``least_share`` of the labelled rows have. The bound makes the sample; its
    n-gram counts are summed by Spark into a table of fixed size. Rows without text or label are passed over; labels may in
    part be wrong. Without any labelled row the model knows one language, and so finds no other.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), language_code(lang).alias("lang")).where("lang is not null and length(trim(text)) > 0")
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = tuple(sorted(r["lang"] for r in share if r["n"] >= least_share * sum(x["n"] for x in share))) or ("en",)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    sample = rows.where(F.col("lang").isin(*languages)).withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(languages), len(ORDERS) << BITS))
        for pdf in batches:
            for lang_, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for at in slices(texts):
                    codes, _ = batch_codes([f" {t} " for t in _letters(texts[at])], max(ORDERS))
                    inside = codes != 2
                    for i, h in enumerate(rolling_hashes(codes, ORDERS, BITS)):
                        totals[languages.index(lang_), i << BITS : (i + 1) << BITS] += np.bincount(h[inside], minlength=1 << BITS)
        at = np.nonzero(totals)
        yield pd.DataFrame({"language": at[0], "bucket": at[1], "n": totals[at].astype("int64")})

    table = sample.select("lang", "text").mapInPandas(count, "language bigint, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(ORDERS) << BITS, len(languages)))
    counts[table["bucket"], table["language"]] = table["n"]
    counts = counts.reshape(len(ORDERS), 1 << BITS, len(languages)) + 0.05
    return LanguageModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
