"""Broken prompt and response pairs, and answers that were cut."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.grams import slices
from wattloom.llm.languages import LanguageModel
from wattloom.llm.truncation import bare, with_cuts
from wattloom.operators.joins import spread

EMPTY, TRUNCATED, REFUSAL, COPY, OTHER_LANGUAGE = "empty", "truncated", "refusal", "copy", "other_language"

#: What stands in for no answer.
STAND_INS = frozenset("none null nan na n/a nil undefined empty missing void unknown tbd - -- -/- . .. ... … ? ?? #n/a <null> [null] {} [] \"\" ''".split())

#: Cues that a clause declines or can't answer, by language. Word stems of common phrasings, not whole sentences.
REFUSAL_CUES = re.compile(
    "|".join(
        [
            # English
            r"\b(?:can ?not|can['’]t|could ?n['’]t|could not|unable to|not able to|not possible|impossible|improper)\b[^.!?;]*\b(?:help|assist|answer|reply|respond|provide|say|tell|comment|discuss|determine|derive|work this out|give|offer|comply|share|do that)",
            r"\b(?:not|outside|beyond)\b[^.!?;]*\b(?:allowed|permitted|comfortable|may discuss|i was given|my scope|in a position)",
            r"\b(?:must|have to|will|would|prefer to|rather|going to)\b[^.!?;]*\b(?:decline|refrain|pass|leave this|not guess|not say|not answer|abstain)",
            r"\bno (?:answer|reply|statement|response)\b[^.!?;]*\b(?:can|could|possible|derived|given|available|offered)",
            r"\b(?:do not|don['’]t|did not|didn['’]t) (?:know|have (?:the|any|enough|access)|feel comfortable|see any)",
            r"\b(?:nothing|none)\b[^.!?;]*\b(?:in the (?:passages|context|material|records|summaries)|says?|be said|on the matter|deals? with|lets? me|useful)",
            r"\bsays? nothing\b|\bhave no access\b|\black(?:s|ing)? the (?:records|data|information|context)\b|\bnot supplied\b|\binsufficient\b|\bnot enough (?:data|context|information)\b|\bi decline\b|\bi refuse\b",
            # German
            r"\b(?:kann|können|darf|möchte|will|vermag)\b[^.!?;]*\b(?:nicht|keine?n?|nichts)\b",
            r"\b(?:keine?n?|nichts)\b[^.!?;]*\b(?:angaben?|antwort|auskunft|daten|informationen|beantworten|hervor|möglich)",
            r"\b(?:muss|müssen)\b[^.!?;]*\b(?:passen|ablehnen|verzichten)\b|\bnicht (?:beantworten|möglich|befugt|in der lage)\b|\bweiß (?:ich |es )*nicht\b",
            # French
            r"\bne\b[^.!?;]*\b(?:peux|peut|puis|pouvons|sais|saurais|permet(?:tent)?|dispose|souhaite|suis)\b[^.!?;]*\b(?:pas|rien|aucun)|\bje n['’](?:ai|y) [^.!?;]*\b(?:pas|aucune?)\b",
            r"\b(?:rien|aucune?)\b[^.!?;]*\b(?:traite|contexte|réponse|information|passages?|permet)|\bimpossible de\b|\bm['’]abstenir\b|\bfaute d['e’]",
            # Spanish
            r"\bno\b[^.!?;]*\b(?:puedo|puede|podemos|dispongo|tengo|permiten?|sé|trata|hay respuesta|deseo|debo|quiero|es posible)\b",
            r"\b(?:nada|ningún|ninguna)\b[^.!?;]*\b(?:contexto|pasajes|trata|respuesta|permite)|\bprefiero (?:no|abstenerme)\b|\bimposible\b|\bdebo abstenerme\b",
        ]
    ),
    re.I,
)

#: Words one of which any refusal cue holds; a cheap test before the patterns.
CUE_WORDS = frozenset(
    """can cannot can't t could couldn unable able not impossible possible improper outside beyond must have will would prefer rather going no do don
    did didn nothing none says say access lack lacks insufficient enough decline refuse supplied
    kann können darf möchte will vermag keine kein keinen nichts nicht muss müssen weiß ne n rien aucun aucune m faute nada ningún ninguna prefiero imposible debo""".split()
)

#: Clauses that go with a refusal and give nothing of substance.
COURTESY = re.compile(
    r"^\W*(?:sorry|(?:my )?apologies|i apologi[sz]e|i['’]m (?:sorry|afraid)|i am (?:sorry|afraid)|unfortunately|regrettably|i regret|with respect|thank|thanks|i hope|please|feel free|let me know|you (?:may|can|could)|as matters stand|a human|another|it is best|consider|perhaps|"
    r"leider|entschuldig|es tut mir leid|tut mir leid|danke|bitte|désolé|je suis désolé|merci|veuillez|malheureusement|je regrette|n['’]hésitez|lo siento|gracias|por favor|lamentablemente|disculp)",
    re.I,
)
CONTRAST = re.compile(r"[.!?;:]+(?:\s+|$)|,?\s+\b(?:but|yet|still|however|nevertheless|though|aber|jedoch|dennoch|mais|cependant|toutefois|pero|sin embargo|aunque)\b,?\s*", re.I)
WORD = re.compile(r"\w+")
QUOTED = re.compile(r"\"[^\"]{8,}\"?|«[^»]{8,}»?|“[^”]{8,}”?|„[^“”]{8,}[“”]?")
INVISIBLE = re.compile(r"[\s­​-‏⁠﻿]+")


def is_empty(answer: str | None) -> bool:
    """No letters or digits, or nothing but a stand-in for no answer."""
    if answer is None:
        return True
    text = INVISIBLE.sub(" ", answer).strip()
    if text.casefold() in STAND_INS or not any(c.isalnum() for c in text):
        return True
    return text.strip("\"'`*_<>[](){}.!#").strip().casefold() in STAND_INS


def is_copy(question: list[str], answer: list[str], spare: int = 2) -> bool:
    """Whether the answer's words are the question's but for ``spare``, which don't follow after it as an answer does."""
    if len(question) < 3 or len(answer) < 3:
        return False
    asked = set(question)
    inside = [w in asked for w in answer]
    extra = len(answer) - sum(inside)
    if extra > spare or len(asked & set(answer)) < 0.5 * len(asked):
        return False
    return extra == 0 or inside[-1]


def is_refusal(answer: str) -> bool:
    """Some clause declines and none has substance: a number, or a statement of its own."""
    declined = False
    text = unicodedata.normalize("NFC", bare(answer))
    for clause in CONTRAST.split(text):
        if not clause or not clause.strip():
            continue
        if REFUSAL_CUES.search(clause):
            declined = True
            if any(c.isdigit() for c in clause):
                return False
        elif not COURTESY.search(clause) and (any(c.isdigit() for c in clause) or len(WORD.findall(clause)) >= 4):
            return False
    return declined


def pair_defects(
    df: DataFrame, id_col: str, question: str, answer: str, source: str, languages: LanguageModel, margin: float = 8.0
) -> DataFrame:
    """(id, source, defect) of every pair; defect is null for a sound one.

    A pair has the first that holds of: ``empty``; ``copy`` of the question; ``refusal``; ``truncated``, by the likelihood
    that a text ends so and the hazard of its length in its source; ``other_language``, where the posteriors of question
    and answer (without quotations) differ by ``margin`` nats or more.

    Null answers are empty; a null question is no reason for a defect; repeated rows each get a row; an empty table gives
    none. The pairs aren't shuffled as long as the tables of limits and endings fit into every task; extra columns are ignored.
    """
    rows = df.select(F.col(id_col), F.col(source).alias("source"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    rows = with_cuts(spread(rows), "answer", "source", id_col)
    types = dict(df.dtypes)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in slices(pdf["answer"]):
                part = pdf.iloc[at]
                yield part[[id_col, "source"]].assign(defect=defects(part["question"].tolist(), part["answer"].tolist(), part["cut"].to_numpy(dtype=bool)))

    def defects(questions: list, answers: list, cut: np.ndarray) -> list[str | None]:
        found: list[str | None] = [None] * len(answers)
        rest = []
        for i, (q, a) in enumerate(zip(questions, answers, strict=True)):
            if is_empty(a):
                found[i] = EMPTY
                continue
            words = WORD.findall(a.casefold())
            if q and is_copy(WORD.findall(q.casefold()), words):
                found[i] = COPY
            elif not CUE_WORDS.isdisjoint(words) and is_refusal(a):
                found[i] = REFUSAL
            else:
                rest.append(i)
        if not rest:
            return found
        texts = [answers[i] for i in rest]
        likely = languages.log_likelihood([QUOTED.sub(" ", bare(t)) for t in texts])
        several, of = np.unique([questions[i] or "" for i in rest], return_inverse=True)
        asked = languages.log_likelihood(several.tolist())[of]
        own = asked.argmax(axis=1)
        ordered = np.sort(asked, axis=1)
        sure = ordered[:, -1] - ordered[:, -2] > 2.0 if ordered.shape[1] > 1 else np.zeros(len(rest), dtype=bool)
        odds = likely.max(axis=1) - likely[np.arange(len(rest)), own]
        for j, i in enumerate(rest):
            if cut[i]:
                found[i] = TRUNCATED
            elif sure[j] and odds[j] >= margin:
                found[i] = OTHER_LANGUAGE
        return found

    return rows.mapInPandas(classify, f"`{id_col}` {types[id_col]}, source {types[source]}, defect string")


def truncated_answers(df: DataFrame, id_col: str, question: str, answer: str, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, ``keep``, source, truncated, at_limit) of every answer.

    ``at_limit``: the length's hazard in its source is significantly above that of the neighbouring lengths, with most of
    the answers of that length in excess. Answers that are empty, refuse or copy the question aren't truncated. Null
    answers aren't either; repeated rows each get a row; an empty table gives none; other columns are ignored.
    """
    rows = df.select(F.col(id_col), *keep, F.col(source).alias("source"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    rows = with_cuts(rows, "answer", "source", id_col)
    types = dict(df.dtypes)
    # only the texts of cuts are looked at again
    rows = rows.withColumns({"question": F.when(F.col("cut"), F.col("question")), "answer": F.when(F.col("cut"), F.col("answer"))})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = pdf["cut"].to_numpy(dtype=bool).copy()
            for j in np.flatnonzero(cut):
                q, a = pdf["question"].iloc[j], pdf["answer"].iloc[j]
                cut[j] = not (is_empty(a) or (q and is_copy(WORD.findall(q.casefold()), WORD.findall(a.casefold()))) or is_refusal(a))
            yield pdf[[id_col, *keep, "source", "at_limit"]].assign(truncated=cut)

    kept = "".join(f", `{c}` {types[c]}" for c in keep)
    return rows.mapInPandas(judge, f"`{id_col}` {types[id_col]}{kept}, source {types[source]}, truncated boolean, at_limit boolean")
