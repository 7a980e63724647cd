"""Where models plug in: embedding, pair scoring, generation and judging run as vectorised functions over partitions.

A model is a plain Python callable over a list; it is loaded once per worker. External calls aren't repeatable, so what
they give is written before it is used (``sources.sinks.append_new``), and a run resumes with what is missing.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding(model: Callable[[list[str]], Sequence[Sequence[float]]], text: Column | str) -> Column:
    """ARRAY<FLOAT> per text; null for a null text."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        vectors = pd.Series(list(model(known.tolist())), index=known.index, dtype=object) if len(known) else pd.Series(dtype=object)
        return vectors.reindex(texts.index).where(lambda x: x.notna(), None)

    return embed(F.col(text) if isinstance(text, str) else text)


def pair_score(model: Callable[[list[str], list[str]], Sequence[float]], question: Column | str, document: Column | str) -> Column:
    """DOUBLE per pair of texts; null counts as ''."""

    @F.pandas_udf("double")
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(list(model(q.fillna("").tolist(), d.fillna("").tolist())), dtype=float)

    c = lambda x: F.col(x) if isinstance(x, str) else x
    return score(c(question), c(document))


def similarity_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff and Obershelp's similarity of two texts in lower case, from 0 to 1."""
    ratio = lambda xs, ys: [difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(xs, ys, strict=True)]
    return pair_score(ratio, a, b)


def generate(df: DataFrame, prompt: str, model: Callable[[list[str]], Sequence[str]], out: str = "answer", batch: int = 64) -> DataFrame:
    """Answers, with ``latency_sec`` and ``error``: a batch that fails gives null answers and the message, not a failed job."""
    import time

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part, began = pdf.iloc[i : i + batch], time.monotonic()
                try:
                    answers, error = list(model(part[prompt].fillna("").tolist())), ""
                except Exception as e:  # noqa: BLE001
                    answers, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield part.assign(**{out: answers, "latency_sec": (time.monotonic() - began) / len(part), "error": error})

    return df.mapInPandas(run, f"{fields}, `{out}` string, latency_sec double, error string")


def judge(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], metrics: Sequence[str], key: str, batch: int = 5) -> DataFrame:
    """Scores (key, metrics) of a judge that reads ``batch`` rows at a time; null for a batch that it can't score."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].reset_index(drop=True)
                try:
                    scores = model(part)
                except Exception:  # noqa: BLE001
                    scores = pd.DataFrame(index=part.index)
                yield pd.concat([part[[key]], scores.reindex(columns=list(metrics)).astype(float)], axis=1)

    return df.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{m} double" for m in metrics))


def lexical_judge(rows: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a judge: word overlap of answer, context and question."""
    words = lambda s: s.fillna("").str.lower().str.split().map(set)
    a, c, q = words(rows["answer"]), words(rows["context"]), words(rows["question"])
    share = lambda x, y: [len(i & j) / max(len(i), 1) for i, j in zip(x, y, strict=True)]
    return pd.DataFrame({"faithfulness": share(a, c), "answer_relevancy": share(q, a), "context_precision": share(c, q), "context_recall": share(q, c)})
