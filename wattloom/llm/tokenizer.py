"""Streaming encoding with a public byte-level BPE vocabulary.

A transducer reads a text piece by piece and emits tokens as soon as no later byte can change them. After every byte it
knows the last token of what it has read of a word, since exactly one token that ends there agrees with the token before
it; a token is settled once all ends from which a later token may start lead back to it. How far that can lie behind is a
property of the merge list: a merge is undone only by one of higher priority that overlaps its right end, and that one only
by a yet higher one further right, so the longest such chain bounds the lookahead, and with it the memory.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the vocabulary's public pattern of words, numbers, signs and white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The kinds of signs of which a word of any length consists, after its first sign.
KINDS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")


class MergeList:
    """The tokens of a vocabulary with their priorities, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        """Bytes after a position that suffice to know whether a token ends there."""
        if self._lookahead is None:
            #: by prefix: the farthest that a higher merge starting with it reaches, counted from its own start
            reach: dict[bytes, int] = {}
            most = 0
            for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(token) < 2:
                    continue
                beyond = max((reach.get(token[i:], 0) - (len(token) - i) for i in range(1, len(token))), default=0)
                far = len(token) + max(0, beyond)
                most = max(most, far)
                for i in range(1, len(token)):
                    if reach.get(token[:i], 0) < far:
                        reach[token[:i]] = far
            self._lookahead = most
        return self._lookahead

    @lru_cache(maxsize=None)  # noqa: B019 - one entry a token at most, and one merge list a worker
    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes a token; a single byte has none."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    @lru_cache(maxsize=None)  # noqa: B019
    def border(self, token: bytes, side: int) -> list[tuple[bytes, float, float]]:
        """What stands at the left (0) or right (1) border of a token while it is made: part, when it comes up, when it goes."""
        out, gone = [], float("inf")
        while True:
            made = self.ranks[token] if len(token) > 1 else -1
            out.append((token, made, gone))
            if len(token) == 1:
                return out
            token, gone = self.halves(token)[side], made

    def agree(self, a: bytes, b: bytes) -> bool:
        """Whether ``b`` can follow ``a``: no merge across their border comes before what stands there is merged away."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= 1_000_000:
                self._pairs.clear()
            known = self._pairs[a, b] = not any(self._joined(x, y) for x in self.border(a, 1) for y in self.border(b, 0))
        return known

    def _joined(self, left: tuple[bytes, float, float], right: tuple[bytes, float, float]) -> bool:
        rank = self.ranks.get(left[0] + right[0])
        if rank is None:
            return False
        when = max(rank, left[1], right[1])
        # of equal merges the leftmost comes first
        return when < left[2] and (when < right[2] or when == rank == right[2])


class WordTransducer:
    """Tokens of one word whose bytes come in parts."""

    __slots__ = ("rules", "held", "last", "due")

    def __init__(self, rules: MergeList):
        self.rules = rules
        #: bytes that aren't settled, and for each end in them the last token there; at 0, the token before them
        self.held, self.last = b"", [b""]
        self.due = 2 * rules.longest

    def feed(self, part: bytes) -> Iterator[int]:
        """Read on; the ids of the tokens that no later byte can change."""
        rules, last = self.rules, self.last
        ranks, agree, longest = rules.ranks, rules.agree, rules.longest
        held = self.held = self.held + part
        for end in range(len(last), len(held) + 1):
            for start in range(max(0, end - longest), end):
                token = held[start:end]
                if token in ranks and (not last[start] or agree(last[start], token)):
                    last.append(token)
                    break
        if len(held) >= self.due:
            yield from self._emit(self._settled())
            self.due = len(self.held) + self.rules.longest

    def _settled(self) -> int:
        """The farthest end to which all ends lead back from which a later token may start."""
        last, n = self.last, len(self.held)
        path, at = {0}, n
        while at > 0:
            path.add(at)
            at -= len(last[at])
        common = n
        for at in range(max(0, n - self.rules.longest + 1), n):
            while at not in path:
                at -= len(last[at])
            common = min(common, at)
        return common

    def _emit(self, upto: int) -> Iterator[int]:
        tokens, at = [], upto
        while at > 0:
            tokens.append(self.last[at])
            at -= len(tokens[-1])
        self.held, self.last = self.held[upto:], self.last[upto:]
        return (self.rules.ranks[t] for t in reversed(tokens))

    def finish(self) -> Iterator[int]:
        """The ids of what is left: a word's end settles all of it."""
        return self._emit(len(self.held))


class BytePairTransducer:
    """Encoder with constant memory beside its output: a text is read in blocks of ``block`` signs.

    The ids of words of up to ``remember`` bytes are remembered, ``cache_size`` of them.
    """

    def __init__(self, ranks: dict[bytes, int], block: int = 4096, cache_size: int = 200_000, remember: int = 64):
        self.rules, self.block, self.cache_size, self.remember = MergeList(ranks), block, cache_size, remember
        self.pattern, self.kinds = regex.compile(PATTERN), [regex.compile(k) for k in KINDS]
        self.cache: dict[str, list[int]] = {}
        self.vocabulary = {i: b for b, i in ranks.items()}

    def word(self, piece: str) -> list[int]:
        if (ids := self.cache.get(piece)) is None:
            raw = piece.encode("utf-8", "replace")
            machine = WordTransducer(self.rules)
            ids = [*machine.feed(raw), *machine.finish()]
            if len(raw) <= self.remember and len(self.cache) < self.cache_size:
                self.cache[piece] = ids
        return ids

    def encode_parts(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Token ids of a text that comes in blocks, block by block, without special tokens.

        A block's last words wait for the next block, as it may go on with them; a word longer than a block goes to its
        transducer part by part, but for the last sign of white space, which may belong to the next word.
        """
        held, long, kind = "", None, self.kinds[0]
        space, known, word = self.kinds[-1], self.cache.get, self.word
        for block in blocks:
            held += block
            ids: list[int] = []
            if long is not None:
                run = kind.match(held)
                end = run.end() if run else 0
                upto = end - 1 if kind is space else end
                ids += long.feed(held[:upto].encode("utf-8", "replace"))
                over, held = end < len(held), held[upto:]
                if not over:
                    yield ids
                    continue
                ids += long.finish()
                long = None
            pieces = self.pattern.findall(held)
            for piece in pieces[:-3]:
                ids += known(piece) or word(piece)
            pieces = pieces[-3:]
            if pieces and len(pieces[-1]) > self.block:
                for piece in pieces[:-1]:
                    ids += known(piece) or word(piece)
                kind = next(k for k in self.kinds if k.match(pieces[-1][-1]))
                held = pieces[-1][-1:] if kind is space else ""
                long = WordTransducer(self.rules)
                ids += long.feed(pieces[-1][: len(pieces[-1]) - len(held)].encode("utf-8", "replace"))
            else:
                held = "".join(pieces)
            yield ids
        if long is not None:
            yield [*long.feed(held.encode("utf-8", "replace")), *long.finish()]
        else:
            yield [i for piece in self.pattern.findall(held) for i in known(piece) or word(piece)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in self.encode_parts(text[i : i + self.block] for i in range(0, len(text), self.block)):
            out += ids
        return out

    def decode_parts(self, ids: Iterable[int], parts: int = 512) -> Iterator[str]:
        """Text of the ids, by an incremental machine that holds back unfinished characters."""
        machine, left = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while raw := b"".join(map(self.vocabulary.__getitem__, islice(left, parts))):
            yield machine.decode(raw)
        yield machine.decode(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_parts(ids))


@lru_cache(maxsize=2)
def transducer(path: str = VOCABULARY) -> BytePairTransducer:
    """One per Python worker, read from the file that every machine has."""
    with open(path, "rb") as f:
        return BytePairTransducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encoded(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of a text column.

    Null texts and empty texts both have no tokens: an empty list. Blank texts are encoded like any other. Texts
    are read in blocks. No shuffle takes place; ``out`` replaces a column of that name.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = transducer(path).encode
        return pd.Series([encode(t) if t else [] for t in texts], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def decoded(df: DataFrame, ids: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of a column of token ids; null for null, '' for an empty list."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        decode = transducer(path).decode
        return pd.Series([None if x is None else decode(list(map(int, x))) for x in lists], dtype=object)

    return df.withColumn(out, text(F.col(ids)))
