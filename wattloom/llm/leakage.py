"""Held-out evaluation passages inside a corpus, by greedy string tiling over shared-token seeds.

The items are the query side and are held by every task, in blocks of bounded size; the corpus is read in parallel and
never shuffled. Within a batch of documents the running hash of ``k`` words finds the seeds, equal words confirm them, and
bounds that can't exclude a case tell which pairs of document and passage are tiled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wattloom.llm.grams import slices
from wattloom.operators.joins import spread
from wattloom.session import checkpointed

#: Signs that are no part of a word: markup tags and characters without width.
MARKUP = r"<[^<>]+>|&[a-zA-Z]+;"
WIDTHLESS = "[\\u00AD\\u200B-\\u200F\\u2060\\uFEFF\\u202A-\\u202E]"
WORDS = r"[\p{L}\p{M}]+|\p{N}+(?:[.,:]\p{N}+)*"


def words_of(text: Column) -> Column:
    """Lower-case words and numbers of a text; case, punctuation, spacing and markup leave no trace."""
    plain = F.regexp_replace(F.regexp_replace(text, WIDTHLESS, ""), MARKUP, " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(WORDS), F.lit(0))


#: Of the running hash: an odd base, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def running_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp and Rabin's hash of the ``k`` ids from each place on, modulo 2**64, from one running sum over all ids."""
    n = len(ids)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(BASE, n + 1), powers(INVERSE, n + 1)
    # sum of (id + 1) * BASE**-place; a difference of two sums, shifted back to its own place, is the window's hash
    sums = np.r_[np.uint64(0), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * down[:n])]
    return (sums[k:] - sums[:-k]) * up[: n - k + 1]


def tile(pattern_at: np.ndarray, text_at: np.ndarray, k: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern position, text position, length) of non-overlapping matches, longest first.

    The seeds that two texts share are given by position; runs of them along a diagonal are the maximal matches. What an
    earlier tile took away is cut off a match, and the rest goes back in line if it is ``least`` long. Of matches of one
    length the first in the pattern, then in the text, comes first.
    """
    diagonal = text_at - pattern_at
    order = np.lexsort((pattern_at, diagonal))
    p, d = pattern_at[order], diagonal[order]
    breaks = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(p) != 1)])
    lengths = np.diff(np.r_[breaks, len(p)]) + k - 1
    queue = [(-int(n), int(p[b]), int(p[b] + d[b])) for b, n in zip(breaks, lengths, strict=True) if n >= least]
    heapq.heapify(queue)
    if not queue:
        return []
    first = min(j for _, _, j in queue)
    taken_p = np.zeros(max(i - n for n, i, _ in queue), dtype=bool)
    taken_t = np.zeros(max(j - n for n, _, j in queue) - first, dtype=bool)
    tiles = []
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        free = ~(taken_p[i : i + n] | taken_t[j - first : j - first + n])
        if free.all():
            tiles.append((i, j, n))
            taken_p[i : i + n] = taken_t[j - first : j - first + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(queue, (a - b, i + a, j + a))
    return tiles


def covered_share(tiles: list[tuple[int, int, int]], upto: np.ndarray, reach: float) -> float:
    """The most weight of a passage (sums in ``upto``) in tiles that lie together: within ``reach`` times its length."""
    found = sorted(tiles, key=lambda x: x[1])
    gain = [upto[i + n] - upto[i] for i, _, n in found]
    best, lo, total = 0.0, 0, 0.0
    for (_, at, length), g in zip(found, gain, strict=True):
        total += g
        while at + length - found[lo][1] > reach * (len(upto) - 1):
            total -= gain[lo]
            lo += 1
        best = max(best, total)
    return float(best / max(upto[-1], 1e-9))


@dataclass
class Passages:
    """A block of passages: their words as numbers, end to end, with the places where each seed stands."""

    items: list
    fields: list[str]
    vocabulary: dict[str, int]
    words: np.ndarray
    starts: np.ndarray
    least: np.ndarray
    upto: list[np.ndarray]
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[Row], shares: dict[str, float], k: int) -> Passages:
        vocabulary: dict[str, int] = {}
        coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in r["w"]], dtype=np.int64) for r in rows]
        seeds = [running_hashes(c, k) for c in coded]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, dtype=np.int64)
        flat = np.concatenate(seeds) if seeds else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        starts = np.r_[0, np.cumsum([len(c) for c in coded])].astype(np.int64)
        return cls(
            [r["item"] for r in rows], [r["field"] for r in rows], vocabulary, np.concatenate(coded) if coded else np.empty(0, dtype=np.int64), starts,
            np.array([shares[r["field"]] for r in rows]), [np.r_[0.0, np.cumsum(r["weights"])] for r in rows], flat[order], owner[order], place[order],
        )

    def shared_seeds(self, texts: Sequence[Sequence[str]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, text place, passage place) of every seed that a text and a passage have in common."""
        n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ids = np.fromiter((i for t in texts for i in map(self.vocabulary.get, t, repeat(-1))), dtype=np.int64, count=int(n.sum()))
        starts = np.r_[0, np.cumsum(n)]
        h = running_hashes(ids, k)
        within = np.ones(len(h), dtype=bool)  # all words known, and none of the next text
        for j in range(k):
            within &= ids[j : j + len(h)] >= 0
        text = np.repeat(np.arange(len(texts)), n)[: len(h)]
        within &= np.arange(len(h)) + k <= starts[text + 1]
        at = np.flatnonzero(within)
        lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
        times = hi - lo
        at, lo, times = at[times > 0], lo[times > 0], times[times > 0]
        where = np.repeat(lo - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        at = np.repeat(at, times)
        passage, place = self.owner[where], self.place[where]
        same = np.ones(len(at), dtype=bool)  # equal hashes are confirmed on the words
        for j in range(k):
            same &= ids[at + j] == self.words[self.starts[passage] + place + j]
        return text[at[same]], passage[same], (at - starts[text[at]])[same], place[same]

    def tilings(self, texts: Sequence[Sequence[str]], k: int, run: int, reach: float) -> Iterator[tuple[int, int, int, float]]:
        """(text, passage, longest tile, covered share) of all pairs that reach ``run`` or their field's share."""
        text, passage, at, place = self.shared_seeds(texts, k)
        if not len(text):
            return
        pair = text * np.int64(len(self.items)) + passage
        order = np.lexsort((place, at - place, pair))
        pair, at, place = pair[order], at[order], place[order]
        new = np.r_[True, pair[1:] != pair[:-1]]
        breaks = np.flatnonzero(new | np.r_[True, (np.diff(at - place) != 0) | (np.diff(place) != 1)])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        longest = np.zeros(len(starts), dtype=np.int64)
        np.maximum.at(longest, which[breaks], np.diff(np.r_[breaks, len(pair)]) + k - 1)
        # no tiling covers more than all words of the passage that stand in some shared seed
        owner = pair[starts] % len(self.items)
        size = int(np.diff(self.starts).max()) + k
        marks = np.unique(np.concatenate([which * size + place + j for j in range(k)]))
        weight = np.concatenate([np.diff(u) for u in self.upto])
        most = np.bincount(marks // size, weights=weight[self.starts[owner[marks // size]] + marks % size], minlength=len(starts))
        total = np.array([max(u[-1], 1e-9) for u in self.upto])[owner]
        ends = np.r_[starts[1:], len(pair)]
        for i in np.flatnonzero((longest >= run) | (most / total >= self.least[owner] - 1e-9)):
            part = slice(starts[i], ends[i])
            tiles = tile(place[part], at[part], k, k)
            covered = covered_share(tiles, self.upto[owner[i]], reach)
            if longest[i] >= run or covered >= self.least[owner[i]]:
                yield int(pair[starts[i]] // len(self.items)), int(owner[i]), int(longest[i]), covered


def word_weights(passages: DataFrame) -> DataFrame:
    """(passage, weights): for each position of a passage, how well its word tells the items apart."""
    at = passages.select("passage", "item", F.posexplode("w").alias("i", "word"))
    having = at.groupBy("word").agg(F.count_distinct("item").alias("having"))
    total = passages.agg(F.count_distinct("item").alias("items")).first()["items"]
    weighed = at.join(having, "word").withColumn("weight", F.log(F.lit(float(total) + 1.0) / F.col("having")))
    return weighed.groupBy("passage").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "weight"))), lambda x: x["weight"]).alias("weights"))


def leaked_items(
    corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: dict[str, float | None],
    k: int = 3, run: int = 12, reach: float = 2.0, block_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, item_id, field, longest, covered, words): which documents give which items away, by which field.

    A document gives an item away if a tile of ``run`` successive words of a field lies in it, or if tiles of ``k`` or more
    words, close to each other, cover the share ``fields[field]`` of the field (null: no such rule for that field). Tiles
    may come in any order, so reordered passages count. In that share a word weighs as it tells the items apart: the log
    of items to items that have it, so wording that many items have in common doesn't make a passage.

    The items are the query side: ``block_bytes`` of their texts at a time are held by every task while the corpus is read;
    the results of each of several blocks are written before the next is taken. Nothing of the corpus is shuffled, so
    neither a common seed nor a big document makes a hot group, and no pair that can reach either bound is passed over.
    Null and empty texts hold nothing; repeated documents each count, an item repeated with the same passage counts once;
    empty tables give no rows; extra columns are ignored.
    """
    doc_type, item_type = dict(corpus.dtypes)[doc_id], dict(items.dtypes)[item_id]
    parts = [items.select(F.col(item_id).alias("item"), F.lit(f).alias("field"), F.col(f).alias("passage")) for f in fields]
    passages = parts[0]
    for p in parts[1:]:
        passages = passages.unionByName(p)
    passages = passages.where("passage is not null").withColumn("w", words_of(F.col("passage"))).where(F.size("w") >= k)
    passages = passages.select("item", "field", "w", F.octet_length("passage").cast("long").alias("bytes"), F.xxhash64("item", "field", "w").alias("passage"))
    passages = checkpointed(passages.dropDuplicates(["item", "field", "w"]))
    weighed = passages.join(word_weights(passages), "passage")
    blocks = max(1, -(-(passages.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // block_bytes))
    shares = {f: (2.0 if s is None else s) for f, s in fields.items()}
    docs = spread(corpus.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))).select("doc", F.array_join(words_of(F.col("text")), " ").alias("words"))
    schema = f"`{doc_id}` {doc_type}, `{item_id}` {item_type}, field string, longest int, covered double, words int"

    def found(block: int) -> DataFrame:
        rows = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "field", "w", "weights").collect()
        shared = corpus.sparkSession.sparkContext.broadcast(Passages.of(rows, shares, k))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages = shared.value
            for pdf in batches:
                for part in slices(pdf["words"], 1 << 20):
                    docs = pdf["doc"].iloc[part].tolist()
                    out = [
                        (docs[t], passages.items[p], passages.fields[p], longest, covered, int(passages.starts[p + 1] - passages.starts[p]))
                        for t, p, longest, covered in passages.tilings([x.split() for x in pdf["words"].iloc[part]], k, run, reach)
                    ]
                    yield pd.DataFrame(out, columns=[doc_id, item_id, "field", "longest", "covered", "words"])

        return docs.mapInPandas(judge, schema)

    if blocks == 1:
        return found(0)
    out = checkpointed(found(0))
    for block in range(1, blocks):
        out = out.unionByName(checkpointed(found(block)))
    return out
