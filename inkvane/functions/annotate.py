"""Providers for what needs a parser, an embedder or a fold: declared approximations behind small interfaces.

The default annotator tags by word lists and endings, the default embedder hashes
words; either can be replaced by an object with the same method. They run in
Arrow batches, one object for each worker.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexicons as L

_AUX = set("is was are were be been being am have has had do does did will would shall should may might must can could".split())
_PRON = set("i me my mine myself we us our ours you your yours he him his she her it its they them their this that these those who whom which what".split())
_DET = set("the a an each every both all some such no few more most other".split())
_ADP = set("in on at to for of with by from as into over after before during until since".split())
_CCONJ, _SCONJ = set("and but or so yet nor".split()), set("because if when while although though unless whereas since that".split())
_VERBS = set(L.EVENTIVE_VERBS) | set(L.COGNITIVE_VERBS) | set(L.CONFLICT_VERBS) | {"laugh"}
_COGNITIVE, _EVENTIVE = set(L.COGNITIVE_VERBS) - set(L.EVENTIVE_VERBS), set(L.EVENTIVE_VERBS)
_PAST = set("went ran came fell stood sat lay left drove flew rode saw heard felt said told took gave held threw caught broke ate drank slept woke understood thought knew forgot learnt".split())
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


#: Tokens of each kind that a worker remembers.
KNOWN = 100_000


class RuleAnnotator:
    """(token, tag, tense) by lists and endings; tense is past, present or empty."""

    def __init__(self) -> None:
        self.known: tuple[dict, dict] = ({}, {})  # tagged tokens, at the beginning of a sentence and after it

    def tag(self, text: str) -> list[list[tuple[str, str, str]]]:
        return [[self._tagged(t, k) for k, t in enumerate(_TOKEN.findall(s))] for s in _SENTENCE.split(text) if s.strip()]

    def _tagged(self, token: str, place: int) -> tuple[str, str, str]:
        known = self.known[place > 0]
        if (found := known.get(token)) is None:
            if len(known) >= KNOWN:
                known.clear()
            found = known[token] = (token, *self.one(token, place))
        return found

    @staticmethod
    def one(token: str, place: int) -> tuple[str, str]:
        w = token.lower()
        if not w[0].isalnum():
            return "PUNCT", ""
        if w[0].isdigit():
            return "NUM", ""
        for tag, words in (("AUX", _AUX), ("PRON", _PRON), ("DET", _DET), ("CCONJ", _CCONJ), ("SCONJ", _SCONJ), ("ADP", _ADP)):
            if w in words:
                return tag, ("past" if w in ("was", "were", "had", "did") else "present") if tag == "AUX" else ""
        if w in _VERBS or w.endswith(("ed", "ing")) and len(w) > 4:
            return "VERB", "past" if w.endswith("ed") or w in _PAST else "present"
        if w.endswith("ly"):
            return "ADV", ""
        if place and token[0].isupper():
            return "PROPN", ""
        return ("ADJ", "") if w.endswith(("ous", "ful", "able", "ive", "al")) else ("NOUN", "")


@lru_cache(KNOWN)
def stem(verb: str) -> str:
    """A verb form as the lists have it: an -ing or -s form becomes the plain one."""
    w = verb.lower()
    tries = [w, w[:-1] if w.endswith("s") else w, *([w[:-3], f"{w[:-3]}e", w[:-4]] if w.endswith("ing") else [])]
    return next((x for x in tries if x in _EVENTIVE or x in _COGNITIVE), w)


def syntax_row(sentences: list[list[tuple[str, str, str]]]) -> dict[str, float]:
    """Markers that need tags; depth is approximated by nested clause openers."""
    tokens = [t for s in sentences for t in s]
    n, s = len(tokens), max(len(sentences), 1)
    count = Counter(t[1] for t in tokens).__getitem__
    verbs = [t for t in tokens if t[1] == "VERB"]
    verbal = [t for t in tokens if t[1] in ("VERB", "AUX")]
    depth = [1 + sum(t[1] in ("SCONJ", "ADP") for t in x) for x in sentences]
    nouns = [t[0].lower() for t in tokens if t[1] == "NOUN"]
    abstract = sum(w.endswith(tuple(L.ABSTRACT_SUFFIXES)) for w in nouns)
    # without a parser every verb counts as the root of a clause
    cognitive = sum(stem(t[0]) in _COGNITIVE for t in verbs)
    eventive = sum(stem(t[0]) in _EVENTIVE for t in verbs)
    fragments = sum(not any(t[1] in ("VERB", "AUX") for t in x) and sum(t[1] != "PUNCT" for t in x) > 1 for x in sentences)
    first = {"eventive": 0, "cognitive": 0}
    for x in sentences:
        for k, t in enumerate(x):
            if t[0].lower() in ("i", "we"):
                verb = next((v for v in x[k + 1 : k + 4] if v[1] == "VERB"), None)
                for kind, known in (("eventive", _EVENTIVE), ("cognitive", _COGNITIVE)):
                    first[kind] += bool(verb) and stem(verb[0]) in known
    return {
        "syn_subordination_ratio": count("SCONJ") / s,
        "syn_mean_parse_depth": float(np.mean(depth)) if depth else 0.0,
        "narr_action_verb_density": len(verbs) / n if n else 0.0,
        "narr_past_tense_ratio": sum(t[2] == "past" for t in verbs) / len(verbs) if verbs else 0.0,
        "voice_proper_noun_density": count("PROPN") / n if n else 0.0,
        "idx_present_tense_ratio": sum(t[2] == "present" for t in verbal) / max(len(verbal), 1),
        "idx_past_tense_ratio": sum(t[2] == "past" for t in verbal) / max(len(verbal), 1),
        "idx_fragment_ratio": fragments / s,
        "idx_eventive_clause_density": eventive / max(len(verbs), 1),
        "idx_cognitive_clause_density": cognitive / max(len(verbs), 1),
        "idx_event_interpretation_ratio": eventive / cognitive if cognitive else float(eventive) or 1.0,
        "idx_cognitive_verb_density": cognitive / s,
        "idx_abstract_noun_ratio": abstract / max(len(nouns), 1),
        "idx_concrete_noun_density": 100 * (len(nouns) - abstract) / max(sum(t[0].isalpha() for t in tokens), 1),
        "idx_fp_eventive_density": first["eventive"] / s,
        "idx_fp_cognitive_density": first["cognitive"] / s,
        "idx_fp_immediacy_ratio": first["eventive"] / first["cognitive"] if first["cognitive"] else float(first["eventive"]) or 1.0,
    }


SYNTAX_COLUMNS = list(syntax_row([]))


def syntax_markers(stories: DataFrame, annotator: Callable[[], RuleAnnotator] = RuleAnnotator) -> DataFrame:
    """Tag-based markers of (id, story); blank texts have nulls. pos is a map: a tag that is absent is absent."""

    def run(batches):
        tagger = annotator()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["story"], strict=True):
                if not isinstance(text, str) or not text.strip():
                    rows.append({"id": i, "pos": None} | dict.fromkeys(SYNTAX_COLUMNS))
                    continue
                sents = tagger.tag(text)
                tags = [t[1] for s in sents for t in s]
                pos = {f"pos_{t.lower()}_ratio": tags.count(t) / len(tags) for t in sorted(set(tags))}
                rows.append({"id": i, "pos": pos} | syntax_row(sents))
            yield pd.DataFrame(rows, columns=["id", "pos", *SYNTAX_COLUMNS])

    return stories.select("id", "story").mapInPandas(run, "id long, pos map<string,double>, " + ", ".join(f"{c} double" for c in SYNTAX_COLUMNS))


class HashedEmbedder:
    """Unit vectors of hashed word counts."""

    size = 256

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for k, t in enumerate(texts):
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                out[k, zlib.crc32(w.encode()) % self.size] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


SEMANTIC_COLUMNS = ["sd_mean_consecutive", "sd_std_consecutive", "sd_max_consecutive", "sd_mean_pairwise", "sd_spread", "coh_local_similarity", "coh_global_similarity"]


def semantic_markers(stories: DataFrame, embedder: Callable[[], HashedEmbedder] = HashedEmbedder) -> DataFrame:
    """Distances between the sentences of over 10 characters; zeros below two. All pairs by their closed form, none sampled."""

    def run(batches):
        model = embedder()
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["story"], strict=True):
                if not isinstance(text, str) or not text.strip():
                    rows.append([i, *[None] * 7])
                    continue
                sents = [s.strip() for s in _SENTENCE.split(text) if len(s.strip()) > 10]
                if len(sents) < 2:
                    rows.append([i, *[0.0] * 7])
                    continue
                e = model.encode(sents)
                local = (e[:-1] * e[1:]).sum(1)
                n, full = len(e), float((e.sum(0) ** 2).sum())
                pairwise = (full - float((e**2).sum())) / (n * (n - 1))
                spread = float(np.linalg.norm(e - e.mean(0), axis=1).std())
                rows.append([i, float((1 - local).mean()), float((1 - local).std()), float((1 - local).max()), 1 - pairwise, spread, float(local.mean()), pairwise])
            yield pd.DataFrame(rows, columns=["id", *SEMANTIC_COLUMNS])

    return stories.select("id", "story").mapInPandas(run, "id long, " + ", ".join(f"{c} double" for c in SEMANTIC_COLUMNS))


def mtld_pass(words: list[str], threshold: float = 0.72) -> float:
    """Factors of one pass: a segment closes when its type-token ratio is at most the threshold; the tail counts in part."""
    factors, types, n = 0.0, set(), 0
    for w in words:
        types.add(w)
        n += 1
        if len(types) / n <= threshold:
            factors, types, n = factors + 1, set(), 0
    if n > 1 and len(types) < n:
        factors += (1 - len(types) / n) / (1 - threshold)
    return len(words) / factors if factors else float(len(words))


def mtld(stories: DataFrame) -> DataFrame:
    """(id, ld_mtld): the mean of a forward and a backward pass; null for blank texts, 0 without words."""

    def run(batches):
        for b in batches:
            out = []
            for t in b["story"]:
                if not isinstance(t, str) or not t.strip():
                    out.append(None)
                    continue
                w = re.findall(r"[^\W\d_]+", t.lower())
                out.append((mtld_pass(w) + mtld_pass(w[::-1])) / 2 if w else 0.0)
            yield pd.DataFrame({"id": b["id"], "ld_mtld": pd.Series(out, dtype="float64")})

    return stories.select("id", "story").mapInPandas(run, "id long, ld_mtld double")


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of word lists, a row at a time."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    y = np.array([ids[w] for w in b], np.int64)
    ramp = np.arange(len(b) + 1)
    row = ramp.copy()
    for k, w in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != ids[w]))
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row[-1])


def pair_distances(pairs: DataFrame, embedder: Callable[[], HashedEmbedder] = HashedEmbedder) -> DataFrame:
    """(id, trans_word_edit_distance, trans_semantic_similarity, trans_char_edit_distance) of (id, orig, rewrite).

    The similarity is null for an empty side. The character distance counts code points of any text, over the longer one's length.
    """

    def run(batches):
        model = embedder()
        for b in batches:
            rows = []
            for i, o, w in zip(b["id"], b["orig"], b["rewrite"], strict=True):
                x, y = (o or "").lower().split(), (w or "").lower().split()
                e = model.encode([o or "", w or ""])
                rows.append((i, edit_distance(x, y) / max(len(x), len(y), 1), float(e[0] @ e[1]) if e.any(1).all() else None))
            out = pd.DataFrame(rows, columns=["id", "trans_word_edit_distance", "trans_semantic_similarity"])
            yield out.assign(trans_char_edit_distance=b["chars"].to_numpy())

    o, w = (F.coalesce(c, F.lit("")) for c in ("orig", "rewrite"))
    chars = F.levenshtein(o, w) / F.greatest(F.length(o), F.length(w), F.lit(1))
    return pairs.select("id", "orig", "rewrite", chars.alias("chars")).mapInPandas(run, "id long, trans_word_edit_distance double, trans_semantic_similarity double, trans_char_edit_distance double")
