"""Keyword-stuffed pages and link lists, told by how their terms recur and by lists of terms without function words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.grams import slices
from wattloom.operators.joins import spread

#: Common function words of the corpus' languages, without those that are also markup or single letters.
FUNCTION_WORDS = frozenset(
    """the of and to in is that for on was with as by at from it be were are this an or which had has have not but its than after before their no other
    these into over so when while during since because about any some all each both we our they he she his her you your who what how there then once near most
    der die das und den von zu mit dem des ein eine einen einem einer ist im auf für nicht als auch es sie er hat dass nach bei um am sind noch wie über zum zur war oder vor
    durch wird wurde weil wenn sich aus ohne bis gegen unter zwischen kein keine
    le la les de du et un une est que qui dans pour sur au aux par ne se avec ce cette il elle sont ou son sa ses mais puis sans sous entre car était
    el los las y en es del con no al lo como más su sus fue este esta porque sin hasta entre sobre cuando ser han una por para
    l d qu n s c j""".split()
)

LINK = re.compile(r"<[^<>]*>|\]\([^()\s]*\)|(?:https?://|www\.)\S+", re.I)
TOKEN = re.compile(r"[^\W_]+")
CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")

FEATURES = ("words", "link_share", "function_share", "number_share", "listed_share", "distinct_share", "gap_share", "recurrence")


def page_features(texts: Sequence[str], lags: int = 30, window: int = 24) -> pd.DataFrame:
    """A row of ``FEATURES`` for each text, computed over all of a batch's words at once.

    Words are those of the source: those of links and tags take part, so a list of links recurs as one of keywords does.
    ``recurrence`` is the positional autocorrelation of the words that carry content (neither numbers nor function words),
    averaged over the window of 1 to ``lags``; ``gap_share`` how many of them recur within a gap of that window;
    ``listed_share`` the share of words in whose surroundings function words and numbers are all but absent, and
    ``distinct_share`` how many of the words that carry content differ.
    """
    pages = [TOKEN.findall(CAMEL.sub(" ", t).casefold()) for t in texts]
    n = np.fromiter(map(len, pages), dtype=np.int64, count=len(texts))
    total = int(n.sum())
    out = pd.DataFrame(0.0, index=range(len(texts)), columns=list(FEATURES))
    out["words"] = n
    out["link_share"] = [sum(m.end() - m.start() for m in LINK.finditer(t)) / max(len(t), 1) for t in texts]
    if not total:
        return out
    code, names = pd.factorize(np.array([w for p in pages for w in p], dtype=object))
    doc = np.repeat(np.arange(len(texts)), n)
    starts = np.r_[0, np.cumsum(n)[:-1]]
    number = np.fromiter((w[0].isdigit() for w in names), dtype=bool, count=len(names))[code]
    function = np.fromiter((w in FUNCTION_WORDS for w in names), dtype=bool, count=len(names))[code]
    content = ~number & ~function
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
    carrying = np.maximum(per_doc(content), 1)
    out["number_share"] = per_doc(number) / np.maximum(n, 1)
    out["function_share"] = per_doc(function) / np.maximum(per_doc(~number), 1)

    sums = lambda x: np.r_[0, np.cumsum(x)]
    lo = np.maximum(np.arange(total) - window // 2, starts[doc])
    hi = np.minimum(np.arange(total) + window // 2 + 1, starts[doc] + n[doc])
    f, m = sums(function), sums(number)
    listed = ((f[hi] - f[lo]) <= 0.1 * (hi - lo)) & ((m[hi] - m[lo]) <= 0.25 * (hi - lo))
    out["listed_share"] = per_doc(listed) / np.maximum(n, 1)
    kinds = np.unique(doc[content] * np.int64(len(names)) + code[content]) // len(names)
    out["distinct_share"] = np.bincount(kinds, minlength=len(texts)) / carrying

    # a word's page is part of what has to agree, so no lag reaches from one page into the next
    place = np.where(content, doc * np.int64(len(names)) + code, -1 - np.arange(total))
    again = np.zeros(total, dtype=np.int16)
    for k in range(1, min(lags, total - 1) + 1):
        again[k:] += place[k:] == place[:-k]
    out["recurrence"] = per_doc(again) / max(lags, 1) / carrying
    out["gap_share"] = per_doc(again > 0) / carrying
    return out


def spam_pages(
    df: DataFrame, id_col: str, text: str, least_words: int = 8, regular: float = 0.065, recurring: float = 0.012, listed: float = 0.6, distinct: float = 0.35, linked: float = 0.38,
) -> DataFrame:
    """(id, the ``FEATURES``, spam, reason) of every page.

    ``stuffed``: the autocorrelation of the content words reaches ``regular``, with most of them back within a gap of the lag
    window, in sentences or not. Otherwise a page is spam if the share ``listed`` of its words stands among other content
    words, next to no function words or numbers, and either the autocorrelation reaches ``recurring``: a ``link_list`` if
    links make up the share ``linked`` of the signs, else a ``term_list``; or ``distinct`` of its content words differ: a
    ``noun_list``. Pages of which a third or more are numbers are readings, not spam. Everything else has a null reason.

    Null and empty texts, and pages of fewer than ``least_words`` words, aren't spam. Repeated pages each get a row; an
    empty table gives none. No shuffle takes place; extra columns are ignored.
    """
    kind = dict(df.dtypes)[id_col]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in slices(pdf["text"], 1 << 20):
                part = pdf.iloc[at].reset_index(drop=True)
                f = page_features(part["text"].fillna("").tolist())
                asked = (f["words"] >= least_words) & (f["number_share"] < 0.33)
                terms = asked & (f["listed_share"] >= listed)
                again = terms & (f["recurrence"] >= recurring)
                stuffed = asked & ~terms & (f["recurrence"] >= regular) & (f["gap_share"] >= 0.5)
                cases = [again & (f["link_share"] >= linked), again, terms & (f["distinct_share"] >= distinct), stuffed]
                reason = np.select(cases, ["link_list", "term_list", "noun_list", "stuffed"], default="")
                yield f.assign(**{id_col: part[id_col], "reason": pd.Series(reason).replace("", None), "spam": reason != ""})[[id_col, *FEATURES, "spam", "reason"]]

    columns = ", ".join(f"{c} double" for c in FEATURES)
    return spread(df.select(F.col(id_col), F.col(text).alias("text"))).mapInPandas(judge, f"`{id_col}` {kind}, {columns}, spam boolean, reason string")
