"""Counts within a text, made for many texts at a time, without a row for each word or gram.

Each function takes an Arrow array with one row for each id, which holds the
texts of that id (or their words between blanks), and gives one row for each id. They
are what grouping the exploded units by (id, unit) and then by id gives; a
slice of about ``UNITS`` units, or one text, is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from . import lexicons as L

UNITS = 1_000_000
WIDEST = 2**62
_TOP = pa.array(L.TOP_FUNCTION_WORDS)


def dense(code: np.ndarray) -> tuple[np.ndarray, int]:
    """The codes as places in their sorted set, and how many there are."""
    known, place = np.unique(code, return_inverse=True)
    return place.astype(np.int64), max(len(known), 1)


def runs(owner: np.ndarray, code: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, count) of each distinct (owner, code), by owner."""
    if n * width > WIDEST:
        code, width = dense(code)
    key = owner * width + code
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // width, np.diff(np.append(first, len(key))).astype(np.float64)


def entropy(owner: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Shannon entropy in bits of the counts of each owner; 0 where there is none."""
    total = np.bincount(owner, c, n)
    safe = np.maximum(total, 1)
    return np.where(total > 0, np.log2(safe) - np.bincount(owner, c * np.log2(c), n) / safe, 0.0)


def code_points(values: pa.Array) -> tuple[np.ndarray, int]:
    """The characters of all strings, one after the other, as places in their alphabet, and its size."""
    points = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), 1
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    place = np.cumsum(seen, dtype=np.int64) - 1
    return place[points], int(place[-1]) + 1


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(array: pa.Array, units: np.ndarray, one: Callable[[pa.Array], dict[str, np.ndarray]]) -> pa.Array:
    """``one`` over slices of whole rows of about UNITS units each, as one array of records."""
    out, a, ends = [], 0, np.cumsum(units)
    while a < len(array) or not out:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + UNITS, "right"))) if len(array) else 0
        cols = one(array.slice(a, b - a))
        out.append(pa.StructArray.from_arrays([pa.array(v) for v in cols.values()], list(cols)))
        a = b
    return pa.concat_arrays(out)


def char_grams(texts: pa.Array) -> pa.Array:
    """Entropy, hapax share and type share of the 2-, 3- and 4-grams of each row's texts of four characters or more."""

    def one(part):
        n, values = len(part), part.flatten()
        owner, size = np.repeat(np.arange(n), lengths(part)), pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        code, v = code_points(values)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the text's end
        left[np.repeat(size < 4, size)] = 0
        whose, gram, width, cols = np.repeat(owner, size), code, v, {}
        for k in (2, 3, 4):
            if width * v > WIDEST:
                gram, width = dense(gram)
            gram, width = gram[:-1] * v + code[k - 1 :] if len(gram) else gram, width * v
            whole = left[: len(gram)] >= k
            o, c = runs(whose[: len(gram)][whole], gram[whole], width, n)
            types, total, once = np.bincount(o, minlength=n), np.bincount(o, c, n), np.bincount(o[c == 1], minlength=n)
            cols |= {f"e{k}": entropy(o, c, n), f"h{k}": once / np.maximum(types, 1), f"t{k}": types / np.maximum(total, 1)}
        return cols

    texts = texts.cast(pa.list_(pa.string()))
    per = np.repeat(np.arange(len(texts)), lengths(texts))
    return sliced(texts, np.bincount(per, pc.binary_length(texts.flatten()).to_numpy(zero_copy_only=False), len(texts)), one)


def split(texts: pa.Array, mark: str) -> tuple[np.ndarray, pa.Array]:
    """The number of parts between marks of each text, and all parts; empty ones do not count."""
    lists = pc.split_pattern(texts, mark)
    parts = lists.flatten()
    keep = pc.binary_length(parts).to_numpy(zero_copy_only=False) > 0
    return np.bincount(np.repeat(np.arange(len(texts)), lengths(lists))[keep], minlength=len(texts)), parts.filter(pa.array(keep))


def _words(part: pa.Array) -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
    """Rows, the row of each text, the number of words of each text, and all words."""
    size, words = split(part.flatten(), " ")
    return len(part), np.repeat(np.arange(len(part)), lengths(part)), size, words


def _by_words(one: Callable) -> Callable[[pa.Array], pa.Array]:
    def run(bags: pa.Array) -> pa.Array:
        bags = bags.cast(pa.list_(pa.string()))
        per = np.repeat(np.arange(len(bags)), lengths(bags))
        blanks = pc.count_substring(bags.flatten(), " ").to_numpy(zero_copy_only=False)
        return sliced(bags, np.bincount(per, blanks + 1, len(bags)), lambda part: one(*_words(part)))

    return run


def _codes(words: pa.Array) -> tuple[np.ndarray, int]:
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(d.dictionary), 1)


@_by_words
def word_counts(n, text, size, words):
    """Sums over the counts c of each row's words, and the counts of the most frequent function words.

    A text without words counts as one more word of count 0 (``size``), the first in ascending order (``ranked``).
    """
    whose = np.repeat(text, size)
    code, width = _codes(words)
    o, c = runs(whose, code, width, n)
    blank = np.bincount(text[size == 0], minlength=n) > 0
    total, types = np.bincount(o, c, n), np.bincount(o, minlength=n).astype(float)
    order = np.lexsort((c, o))
    o, c = o[order], c[order]
    ends = np.cumsum(np.bincount(o, minlength=n))
    back = ends[o] - np.arange(len(o))  # 1 is the most frequent
    rank = types[o] - back + 1
    known = pc.index_in(words, _TOP).to_numpy(zero_copy_only=False)
    hit = ~np.isnan(known) if known.dtype.kind == "f" else np.ones(len(known), bool)
    fw = np.bincount(whose[hit] * len(_TOP) + known[hit].astype(np.int64), minlength=n * len(_TOP)).astype(float)
    return {
        "n": total, "v": types, "v1": np.bincount(o[c == 1], minlength=n).astype(float), "v2": np.bincount(o[c == 2], minlength=n).astype(float), "m2": np.bincount(o, c * c, n),
        "top10": np.bincount(o, np.where(back <= 10, c, 0), n), "top50": np.bincount(o, np.where(back <= 50, c, 0), n), "ranked": np.bincount(o, rank * c, n) + np.where(blank, total, 0), "size": types + blank,
        "fw": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(_TOP), pa.int32()), pa.array(fw)),
    }


@_by_words
def unit_entropies(n, text, size, words):
    """Entropies of each row's words, of the letters that they hold and of the pairs of words that follow each other in a text."""
    whose = np.repeat(text, size)
    code, width = _codes(words)
    letters, v = code_points(words)
    of_letter = np.repeat(whose, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    last = np.zeros(len(code), bool)
    last[np.cumsum(size)[size > 0] - 1] = True
    pair = (code[:-1] * width + code[1:])[~last[:-1]]
    return {"w": entropy(*runs(whose, code, width, n), n), "c": entropy(*runs(of_letter, letters, v, n), n), "b": entropy(*runs(whose[:-1][~last[:-1]], pair, width * width, n), n)}


@_by_words
def word_lengths(n, text, size, words):
    """Words, the number of each length from 1 to 15, the mean length and the second and third central sums."""
    whose, k = np.repeat(text, size), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.bincount(whose, minlength=n).astype(float)
    mu = np.bincount(whose, k, n) / np.maximum(total, 1)
    e, short = k - mu[whose], k <= 15
    by = np.bincount(whose[short] * 15 + k[short] - 1, minlength=n * 15).astype(float)
    return {"n": total, "mu": mu, "m2": np.bincount(whose, e * e, n), "m3": np.bincount(whose, e * e * e, n), "by": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 15, pa.int32()), pa.array(by))}


def cohesion(texts: pa.Array) -> pa.Array:
    """Of each row's texts, the number k of sentences of over two words, and the sum and the least cosine of the word sets of adjacent ones.

    ``u2`` is the squared length of the sum of the unit vectors of all the row's
    sentences. Sentences come between line ends, their words between blanks.
    """

    def one(part):
        n, values = len(part), part.flatten()
        owner = np.repeat(np.arange(n), lengths(part))
        per, sentences = split(values, "\n")
        size, words = split(sentences, " ")
        code, width = _codes(words)
        at = np.repeat(np.arange(len(sentences)), size)
        key = np.unique(at * width + code)  # each word of a sentence once
        at, code = key // width, key % width
        size = np.bincount(at, minlength=len(sentences))
        long = size > 2
        place, key = np.cumsum(long) - 1, key[long[at]]
        at, code, size = place[key // width], key % width, size[long].astype(float)
        text = np.repeat(np.arange(len(values)), per)[long]
        key = at * width + code
        found = np.searchsorted(key, key + width)
        common = np.bincount(at, np.append(key, -1)[found] == key + width, len(size))[:-1]
        near = text[1:] == text[:-1]
        cosine, whose = (common / np.sqrt(size[1:] * size[:-1]))[near], text[1:][near]
        least = np.full(len(values), np.inf)
        np.minimum.at(least, whose, cosine)
        row = owner[text[at]]
        word, which = np.unique(row * width + code, return_inverse=True)
        u = np.bincount(which, 1 / np.sqrt(size[at]), len(word))
        fields = {"k": np.bincount(text, minlength=len(values)).astype(float), "total": np.bincount(whose, cosine, len(values)), "least": least}
        of = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
        ends = np.append(0, np.cumsum(lengths(part)))
        return {"u2": np.bincount(word // width, u * u, n), "of": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of)}

    texts = texts.cast(pa.list_(pa.string()))
    per = np.repeat(np.arange(len(texts)), lengths(texts))
    marks = pc.add(pc.count_substring(texts.flatten(), " "), pc.count_substring(texts.flatten(), "\n")).to_numpy(zero_copy_only=False)
    return sliced(texts, np.bincount(per, marks + 1, len(texts)), one)


def phrases(texts: pa.Array) -> pa.Array:
    """How many of each list's phrases occur in each text, inside words too."""
    values, lists = texts.cast(pa.binary()).to_pylist(), {"retrospective": L.RETROSPECTIVE_PHRASES, "causal": L.CAUSAL_PHRASES}
    found = {k: [p.encode() for p in v] for k, v in lists.items()}
    return pa.StructArray.from_arrays([pa.array([None if t is None else float(sum(p in t for p in v)) for t in values], pa.float64()) for v in found.values()], list(found))


def mtld_factors(words: list) -> float:
    """Segments of one pass that closed at a type-token ratio of 0.72, the tail in part."""
    factors, types, n = 0.0, set(), 0
    for w in words:
        types.add(w)
        n += 1
        if len(types) / n <= 0.72:
            factors += 1
            types, n = set(), 0
    return factors + (1 - len(types) / n) / 0.28 if n > 1 and len(types) < n else factors


def mtld_scores(toks: pa.Array) -> pa.Array:
    """The mean of a forward and a backward pass over each row's words."""
    out = []
    for k in range(len(toks)):
        words = toks[k].values.dictionary_encode().indices.to_pylist()
        n = float(len(words))
        out.append(sum(n / f if f > 0 else n for f in (mtld_factors(words), mtld_factors(words[::-1]))) / 2)
    return pa.array(out, pa.float64())


#: What the relational texts for Spark call, by name.
FUNCTIONS = {
    "inkvane_char_grams": (char_grams, "struct<" + ",".join(f"{c}{k}:double" for k in (2, 3, 4) for c in "eht") + ">"),
    "inkvane_word_counts": (word_counts, "struct<n:double,v:double,v1:double,v2:double,m2:double,top10:double,top50:double,ranked:double,size:double,fw:array<double>>"),
    "inkvane_unit_entropies": (unit_entropies, "struct<w:double,c:double,b:double>"),
    "inkvane_word_lengths": (word_lengths, "struct<n:double,mu:double,m2:double,m3:double,by:array<double>>"),
    "inkvane_cohesion": (cohesion, "struct<u2:double,of:array<struct<k:double,total:double,least:double>>>"),
    "inkvane_phrases": (phrases, "struct<retrospective:double,causal:double>"),
    "inkvane_mtld": (mtld_scores, "double"),
}


def register(spark: SparkSession, text: str) -> None:
    """Make the functions that a text names known to the session."""
    for name, (f, returns) in FUNCTIONS.items():
        if name in text and not spark.catalog.functionExists(name):
            spark.udf.register(name, _udf(f, returns))


def _udf(f: Callable[[pa.Array], pa.Array], returns: str):
    def run(x: pa.Array) -> pa.Array:
        return f(x)

    return arrow_udf(run, returns)
