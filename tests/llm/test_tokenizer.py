from __future__ import annotations

import base64
import random

import pandas as pd
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wattloom.llm.tokenizer import PATTERN, VOCABULARY, BytePairTransducer, MergeList, WordTransducer, decoded, encoded, transducer


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = ["a", "th", "ing", "e", " ", "  ", "\n", "\t", "12", "3.4", "'s", "'", "é", "ß", "😀", "中", "<|endoftext|>", "==", "-", "​", "\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=120), st.sampled_from([3, 8, 33, 1 << 12]), st.sampled_from([0, 64]))
def test_same_as_a_whole_text_encoder(reference, parts, block, remember):
    text = "".join(parts)
    own = BytePairTransducer(transducer().rules.ranks, block=block, remember=remember)
    own.rules = transducer().rules
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text) and own.decode(ids) == text


def test_long_runs_are_emitted_in_constant_memory(reference):
    rng = random.Random(5)
    own = transducer()
    assert 10 < own.rules.lookahead < 20_000
    for alphabet in ("ab", "the", "=-", "é中", " "):
        text = "".join(rng.choices(alphabet, k=12_000))
        machine, ids, most = WordTransducer(own.rules), [], 0
        for i in range(0, len(text), 100):
            ids += machine.feed(text[i : i + 100].encode())
            most = max(most, len(machine.held))
        early = len(ids)
        ids += machine.finish()
        assert own.encode(text) == reference.encode_ordinary(text)
        assert most <= own.rules.lookahead + 3 * own.rules.longest + 400
        assert early > 0.9 * len(ids)
        if alphabet in ("ab", "the"):  # one word
            assert ids == own.encode(text)


def test_real_documents(reference):
    """All documents, without remembered words, in small blocks."""
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].dropna().tolist()
    own = BytePairTransducer(transducer().rules.ranks, block=50, remember=0)
    own.rules = transducer().rules
    assert [own.encode(t) for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_the_transducer_makes_the_ids(reference, monkeypatch):
    """Tokens that were emitted before they are settled, or joined against the merge list, would differ."""
    text = "".join(random.Random(1).choices(["th", "ing", "er", "station", "a"], k=3000))

    def same() -> bool:
        try:
            return BytePairTransducer(transducer().rules.ranks, block=50).encode(text) == reference.encode_ordinary(text)
        except IndexError:  # no token agrees with what went out too early
            return False

    assert same()
    with monkeypatch.context() as m:
        m.setattr(WordTransducer, "_settled", lambda self: len(self.held))
        assert not same()
    with monkeypatch.context() as m:
        m.setattr(MergeList, "agree", lambda self, a, b: True)
        assert not same()


def test_table_round_trip(spark):
    texts = ["Load: 12 MW", "", None, "  ", "naïve\r\n😀" * 300]
    out = decoded(encoded(spark.createDataFrame(list(enumerate(texts)), "i int, text string")), "ids", "back").collect()
    assert [r["ids"] == [] for r in out] == [False, True, True, False, False]
    assert [r["back"] for r in out] == [t or "" for t in texts]
    assert encoded(spark.createDataFrame([], "text string, ids string")).count() == 0
