from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wattloom.llm import spam
from wattloom.llm.languages import train_languages
from wattloom.llm.leakage import Passages, covered_share, leaked_items, running_hashes, tile
from wattloom.llm.pairs import is_copy, is_empty, is_refusal, pair_defects, truncated_answers
from wattloom.llm.spam import page_features, spam_pages
from wattloom.llm.truncation import context_counts, end_probabilities, endings, length_hazards, with_cuts

ENGLISH = ["The zone reached its peak in the evening and fell again at night.", "Demand was lower on the weekend than on working days.", "The meter of the house reported a gap of two hours.", "All readings were compared with those of the year before."]
FRENCH = ["La zone a atteint son maximum dans la soirée puis la charge est retombée.", "La demande était plus faible pendant la fin de semaine.", "Le compteur de la maison a signalé une lacune de deux heures."]
GERMAN = ["Die Zone erreichte ihren Höchstwert am Abend und fiel in der Nacht wieder.", "Die Nachfrage war am Wochenende geringer als an Werktagen."]
SPANISH = ["La zona alcanzó su máximo por la tarde y bajó de nuevo por la noche.", "La demanda fue menor durante el fin de semana que en los días laborables."]


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, " ".join(t), lang) for i, (t, lang) in enumerate([(ENGLISH, "EN"), (FRENCH, "fr"), (GERMAN, "de-DE"), (SPANISH, "es"), (ENGLISH, None), ([""], "fr")])]
    return train_languages(spark.createDataFrame(rows, "id int, text string, lang string"), "text", "lang", "id")


def test_languages_are_those_of_the_labels(spark, languages):
    assert languages.languages == ("de", "en", "es", "fr")
    rows = [(i, "Het net was in de avond zwaarder belast dan in de nacht.", "nl") for i in range(9)] + [(10 + i, ENGLISH[i % 4], "en-GB") for i in range(9)] + [(99, "x", "??")]
    model = train_languages(spark.createDataFrame(rows, "id int, t string, lang string"), "t", "lang", "id")
    assert model.languages == ("en", "nl") and model.log_likelihood(["De nacht was zwaarder belast"])[0].argmax() == 1
    assert train_languages(spark.createDataFrame([], "id int, t string, lang string"), "t", "lang", "id").languages == ("en",)


@pytest.mark.parametrize("answer, empty", [(None, True), ("", True), (" ​\xa0\n", True), ("...", True), ('"None"', True), ("N/A.", True), ("0", False), ("Friday", False), ("no", False)])
def test_empty(answer, empty):
    assert is_empty(answer) is empty


@pytest.mark.parametrize("answer, refusal", [
    ("I'm sorry, but I am not able to answer that from what I have.", True), ("As matters stand, nothing useful can be said from these passages; a human should look at it.", True),
    ("Je préfère m'abstenir, faute de données.", True), ("Leider kann ich diese Frage nicht beantworten.", True), ("Lo siento, no puedo responder a esta pregunta.", True),
    ("I cannot give the exact minute, but demand climbed steadily through the morning.", False), ("There is no answer for the last hour; still, the peak came at 18:00.", False),
    ("No alarm was raised, since the load factor of 0.3 sits inside the usual band.", False), ("I'm sorry for the rough figure: variation stayed modest all day long.", False), ("The load fell.", False),
])
def test_refusals(answer, refusal):
    assert is_refusal(answer) is refusal


def test_copies():
    q = "why did the load of zone 5 change".split()
    assert is_copy(q, q) and is_copy(q, ["question", *q]) and is_copy(q, q + q) and is_copy(q, q[:-1])
    assert not is_copy(q, [*q, "friday"]) and not is_copy(q, [*q, "because", "of", "the", "frost", "and", "wind"]) and not is_copy(q, ["zone", "5"])


def answers():
    rng = random.Random(0)
    full = [" ".join(rng.choices(ENGLISH, k=rng.randint(1, 4))) for _ in range(400)]
    lists = ["Values:\n- Zones compared: %d\n- Trend: rising" % i for i in range(40)]
    cut = [(" ".join(rng.choices(ENGLISH, k=4)))[:150] for _ in range(30)]
    return full, lists, [c for c in cut if not c.endswith(".")]


def test_truncation(spark):
    full, lists, cut = answers()
    rows = [(i, "s", "q", a) for i, a in enumerate([*full, *lists, *cut, "Zone 7", "Zone 8", "Zone 9", "The meter of the house reported a g…", "I cannot answer th", None])]
    df = spark.createDataFrame(rows, "id int, src string, q string, a string").withColumns({"source": F.lit(1), "excess": F.lit("x"), "length": F.lit(None)})
    got = {r["id"] for r in truncated_answers(df, "id", "q", "a", "src").where("truncated").collect()}
    first = len(full) + len(lists)
    assert got == {*range(first, first + len(cut)), len(rows) - 3}
    assert truncated_answers(df.limit(0), "id", "q", "a", "src").count() == 0


def test_context_counts_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n.", k=rng.randint(0, 30))) for _ in range(60)] + ["abab ab", "abab ab", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    asked = df.select(endings("t").alias("e")).where("e.c12 is not null").select(F.explode(F.array("e.c12", "e.c8", "e.c5")).alias("context")).distinct()
    got = {r["context"]: (r["seen"], r["ends"]) for r in context_counts(df, "t", asked).collect()}
    shorn = [t.rstrip() for t in texts if t]
    for r in df.select("t", endings("t").alias("e")).where("e.c12 is not null").collect():
        padded = lambda t: "\2" * 12 + t
        for order, c in ((12, r["e"]["c12"]), (8, r["e"]["c8"]), (5, r["e"]["c5"])):
            context = padded(r["t"].rstrip())[-order:]
            places = [(t, i) for t in map(padded, shorn) for i in range(13, len(t) + 1) if t[i - order : i] == context]
            assert got[c] == (len(places), sum(i == len(t) or t[i] == "\n" for t, i in places))


def unique_texts(n, seed, length=None):
    """Texts that have no contexts in common: what follows is known of none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8))
    out = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(n)]
    return [t[:length] if length and len(t) > length else t + "." for t in out]


def test_the_hazard_decides_where_endings_tell_nothing(spark):
    """The same strange endings are cuts at a significant length, and none where the hazards are even."""
    rows = [(i, "limited", t) for i, t in enumerate(unique_texts(600, 1, 300))] + [(1000 + i, "free", t) for i, t in enumerate(unique_texts(600, 2))] + [(2000, "free", unique_texts(1, 3)[0][:-1])]
    df = spark.createDataFrame(rows, "id int, src string, t string")
    want = {i for i, s, t in rows if s == "limited" and len(t) == 300 and not t.endswith(".")}
    assert len(want) > 100 and {r["id"] for r in with_cuts(df, "t", "src", "id").where("cut").collect()} == want
    alone = df.where("not (src = 'limited' and length(t) = 300)").unionByName(df.where("id = %d" % min(want)))
    assert with_cuts(alone, "t", "src", "id").where("cut").count() == 0


def test_large_tables_are_joined_by_a_shuffle_with_the_same_rows(spark, monkeypatch):
    full, lists, cut = answers()
    df = spark.createDataFrame([(i, "s" if i % 3 else None, a) for i, a in enumerate([*full, *lists, *cut, None, ""])], "id int, src string, t string")
    cuts = lambda: {(r["id"], r["cut"], r["at_limit"]) for r in with_cuts(df, "t", "src", "id").collect()}
    broadcast = cuts()
    monkeypatch.setattr("wattloom.operators.joins.fits", lambda *a: False)
    assert cuts() == broadcast and len(broadcast) == len(full) + len(lists) + len(cut) + 2


def test_hazards_single_out_a_limit(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(50, 400, 4000)]
    rows = [("a", min(x, 300) if i % 2 else x) for i, x in enumerate(lengths)] + [(None, x) for x in lengths] + [("a", None)]
    out = length_hazards(spark.createDataFrame(rows, "src string, l int"), "src", "l").collect()
    assert {(r["source"], r["length"]) for r in out if r["significant"]} == {("a", 300)}
    at = next(r for r in out if r["source"] == "a" and r["length"] == 300)
    assert at["excess"] > 0.9 and at["hazard"] == at["n"] / sum(1 for s, x in rows if s == "a" and x is not None and x >= 300)


def test_defects(spark, languages):
    full, lists, cut = answers()
    q = "What did the meter of the house report on that day?"
    special = [("empty", " "), ("copy", "Question: " + q), ("refusal", "I cannot help with this request."), ("truncated", cut[0]), ("other_language", " ".join(FRENCH)), (None, f'The note of the operator reads "{FRENCH[0]}"'), (None, "Friday"), (None, q + " " + ENGLISH[0])]
    rows = [(i, q, a, "s") for i, a in enumerate([*full, *lists, *["Friday"] * 5])] + [(1000 + i, q, a, "s") for i, (_, a) in enumerate(special)] + [(2000, None, ENGLISH[0], None), (2001, q, None, "s")]
    df = spark.createDataFrame(rows, "id int, q string, a string, src string").withColumn("question", F.lit(0))
    got = {r["id"]: r["defect"] for r in pair_defects(df, "id", "q", "a", "src", languages).collect()}
    assert [got[1000 + i] for i in range(len(special))] == [d for d, _ in special]
    assert got[2000] is None and got[2001] == "empty" and not any(got[i] for i in range(len(full) + len(lists)))


def naive_tiles(p, t, least):
    """Greedy string tiling by trying all starts."""
    used_p, used_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in used_p and j + n not in used_t:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return out
        n, i, j = best[0], -best[1], -best[2]
        out.append((i, j, n))
        used_p.update(range(i, i + n))
        used_t.update(range(j, j + n))


def test_tiling_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        p, t = [rng.choices("abcd", k=rng.randint(5, 25)) for _ in range(2)]
        seeds = [(i, j) for i in range(len(p) - 2) for j in range(len(t) - 2) if p[i : i + 3] == t[j : j + 3]]
        if not seeds:
            continue
        got = tile(np.array([s[0] for s in seeds]), np.array([s[1] for s in seeds]), 3, 3)
        want = naive_tiles(p, t, 3)
        assert got == want
        spots = [x for i, _, n in got for x in range(i, i + n)]
        assert len(spots) == len(set(spots)) and all(p[i : i + n] == t[j : j + n] for i, j, n in got)


def test_running_hashes_and_shared_seeds_against_brute_force():
    rng = random.Random(6)
    ids = np.array(rng.choices(range(5), k=500))
    h = running_hashes(ids, 4)
    grams: dict[tuple, int] = {}
    assert all(grams.setdefault(tuple(ids[i : i + 4]), h[i]) == h[i] for i in range(len(h))) and len(set(grams.values())) == len(grams)
    passages = [rng.choices("abcde", k=n) for n in (9, 3, 2, 14)]
    rows = [Row(item=i, field="f", w=p, weights=[1.0] * len(p)) for i, p in enumerate(passages)]
    texts = [rng.choices("abcdefg", k=n) for n in (0, 2, 3, 40, 25)]
    got = set(zip(*map(np.ndarray.tolist, Passages.of(rows, {"f": 0.5}, 3).shared_seeds(texts, 3)), strict=True))
    want = {(t, p, i, j) for t, x in enumerate(texts) for p, y in enumerate(passages) for i in range(len(x) - 2) for j in range(len(y) - 2) if x[i : i + 3] == y[j : j + 3]}
    assert got == want
    none = Passages.of([], {"f": 0.5}, 3)
    assert not list(none.tilings(texts, 3, 12, 2.0))


def test_bounds_pass_over_no_pair_and_recall_by_altered_words():
    """Against tiling every pair; and how many passages come out with each n-th word altered."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=rng.randint(8, 40)) for _ in range(30)]
    rows = [Row(item=i, field="f", w=p, weights=[1.0] * len(p)) for i, p in enumerate(passages)]
    block = Passages.of(rows, {"f": 0.6}, 3)
    altered = {n: [["x" if i % n == n - 1 else w for i, w in enumerate(p)] for p in passages] for n in (3, 4, 5, 6)}
    share = {}
    for n, texts in altered.items():
        texts = [rng.choices(vocabulary, k=20) + t + rng.choices(vocabulary, k=20) for t in texts]
        got = {(t, p): (longest, covered) for t, p, longest, covered in block.tilings(texts, 3, 12, 2.0)}
        for t, x in enumerate(texts):
            for p, y in enumerate(passages):
                tiles = naive_tiles(y, x, 3)
                longest, covered = max((m for *_, m in tiles), default=0), covered_share(tiles, np.arange(len(y) + 1.0), 2.0)
                assert ((t, p) in got) == (longest >= 12 or covered >= 0.6)
                assert (t, p) not in got or got[t, p] == (longest, pytest.approx(covered))
        share[n] = sum((i, i) in got for i in range(len(passages))) / len(passages)
    assert share[3] == 0 and share[4] > 0.9 and share[5] == share[6] == 1  # runs of two words are below the seed


def test_leaks(spark):
    a = "Only 9 of the 108 records in week 10 of 2019 were complete, hence 1972.5 MW is a floor and 14.0 percent the margin."
    b = "Readings dipped to 213.8 V twice, namely on 7 November at 23:00 and again 34 days later at 1.3 A in that home."
    like = "Only 4 of the 77 records in week 31 of 2008 were complete, hence 88.1 MW is a floor and 6.5 percent the margin."
    items = spark.createDataFrame([("g1", "Was it warm?", a), ("g2", None, b), ("g3", "", None), ("g4", "x", "Only 6 of the 150 records in week 12 of 2001 were complete, hence 3.9 MW is a floor and 40.2 percent the margin.")], "golden_id string, user_query string, reference_answer string")
    words = a.split()
    docs = [
        (1, "Before. " + a.upper().replace(" ", "\n ") + " After."), (2, f"<b>{b[:30]}</b>{b[30:]}"), (3, " ".join(words[4:17])), (4, " ".join(words[4:14])),
        (5, " ".join(w for i, w in enumerate(words) if i % 9 != 4)), (6, like), (7, None), (8, ""), (9, "Was it warm?"), (10, b + " " + "filler words here " * 2000 + f"<i class='{'x' * 5000}'>" + a),
        (11, " ".join(words[12:] + words[:12])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc": F.lit(1), "seed": F.lit("a"), "item": F.lit(None)})
    out = leaked_items(df, "doc_id", "text", items, "golden_id", {"user_query": None, "reference_answer": 0.75})
    got = {(r["doc_id"], r["golden_id"]) for r in out.collect()}
    assert got == {(1, "g1"), (2, "g2"), (3, "g1"), (5, "g1"), (10, "g1"), (10, "g2"), (11, "g1")}
    blocks = leaked_items(df, "doc_id", "text", items.unionByName(items), "golden_id", {"user_query": None, "reference_answer": 0.75}, block_bytes=100)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, out.collect()))
    assert leaked_items(df.limit(0), "doc_id", "text", items, "golden_id", {"reference_answer": 0.75}).count() == 0


def test_spam(spark):
    rng = random.Random(2)
    keywords = "solar panel price cheap energy tariff compare offer".split()
    prose = " ".join(ENGLISH * 3)
    pages = {
        "link_list": ["\n".join(f"https://shop.example/{w}/{i}" for i, w in enumerate(keywords)), " ".join(f'<a href="https://x.example/{w}">{w} offers</a>' for w in keywords * 3)],
        "term_list": [" ".join(rng.choices(keywords, k=90)), " | ".join(f"{rng.choice(keywords)} Town{i}" for i in range(60)), ENGLISH[0] + " " + " ".join(rng.choices(keywords, k=120))],
        "dense": ["Our heat pump offer is the heat pump offer for every heat pump offer buyer. " * 12],
        None: [prose, " ".join(f"Zone {i} averaged {i * 3.1:.1f} MW and peaked at {i % 24:02d}:00." for i in range(20)), prose + " See https://a.example/b and https://c.example/d.", None, "", "Friday", " ".join(f"12:{i:02d} {i * 2.5}" for i in range(50)), prose + " #tag1 #tag2"],
    }
    rows = [(i, t) for i, t in enumerate(t for part in pages.values() for t in part)]
    out = {r["id"]: r["reason"] for r in spam_pages(spark.createDataFrame(rows, "id int, text string").withColumn("words", F.lit(1)), "id", "text").collect()}
    kinds = [k for k, part in pages.items() for _ in part]
    same = {"stuffed": "dense", "noun_list": "term_list"}
    assert [same.get(out[i], out[i]) for i in range(len(rows))] == kinds
    assert spam_pages(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_recurrence_against_brute_force_and_ablation(spark):
    """The autocorrelation by trying all pairs; with no lags the pages of recurring terms don't come out."""
    rng = random.Random(4)
    for _ in range(20):
        words = rng.choices(["solar", "panel", "the", "7", "price", "offer"], k=rng.randint(8, 70))
        content = [w not in ("the", "7") for w in words]
        pairs = sum(words[i] == words[j] and content[i] for i in range(len(words)) for j in range(max(0, i - 30), i))
        assert page_features(["x " + " ".join(words), " ".join(words)]).iloc[1]["recurrence"] == pytest.approx(pairs / 30 / max(sum(content), 1))
    soup = " ".join(rng.choices("solar panel price cheap energy tariff compare offer".split(), k=90))
    long_link = f'<a href="https://x.example/{"q" * 5000}">solar</a> ' * 9
    stuffed = "Our heat pump is the heat pump for every heat pump buyer. " * 9
    df = spark.createDataFrame([(1, soup), (2, stuffed), (3, long_link)], "id int, text string")
    assert {r["id"] for r in spam_pages(df, "id", "text").where("spam").collect()} == {1, 2, 3}
    true, without = spam.page_features, lambda texts: true(texts, lags=0)
    f = pd.concat([true([soup, stuffed]), without([soup, stuffed])])
    assert (f["recurrence"].iloc[:2] > 0.1).all() and not (f["recurrence"].iloc[2:] > 0).any()
    assert (f["distinct_share"] < 0.3).all()  # so nothing but the autocorrelation makes them spam


def test_features_dont_depend_on_the_batch():
    texts = [" ".join(ENGLISH), "a b a b a b a b", "", "Strom Strom günstig " * 20]
    together = page_features(texts)
    for i, t in enumerate(texts):
        assert page_features([t]).iloc[0].to_numpy() == pytest.approx(together.iloc[i].to_numpy())
    assert page_features(["red blue green " * 30]).iloc[0]["recurrence"] == pytest.approx(sum(90 - k for k in range(3, 31, 3)) / 90 / 30)


def test_hazards_against_neighbouring_hazards(spark):
    """A steady hazard has no limit, though its counts fall from length to length; what is expected, by brute force."""
    steady = {x: round(4000 * 0.8**x) for x in range(0, 36) if x != 17}
    uneven = {0: 3, 5: 40, 30: 7, 31: 1, 90: 2}
    rows = [(s, x) for s, counts in (("steady", steady), ("uneven", uneven), ("empty", {0: 9})) for x, n in counts.items() for _ in range(n)]
    out = {(r["source"], r["length"]): r for r in length_hazards(spark.createDataFrame(rows, "src string, l int"), "src", "l").collect()}
    for s, counts in (("steady", steady), ("uneven", uneven)):
        at_risk = lambda x: sum(n for y, n in counts.items() if y >= x)  # noqa: B023, E731
        for x in counts:
            around = [y for y in range(max(0, x - 20), x + 21) if y != x]
            ended = sum(counts.get(y, 0) for y in around) + 1
            want = max(at_risk(x) * ended / sum(at_risk(y) for y in around), ended / sum(y <= max(counts) for y in around))
            assert out[s, x]["expected"] == pytest.approx(want)
    assert not any(r["significant"] for (s, _), r in out.items() if s != "uneven") and out["uneven", 5]["significant"]
