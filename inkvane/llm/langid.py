"""Language of web pages by Bayesian evidence fusion (operator 7).

log P(l | page) = tempered text log likelihood + log P(declared language | l) +
log P(address suffix | l) + log P(l | host), up to a constant. The text model is
a character-trigram profile; the declaration and suffix tables and the host
priors come from grouped counts over all pages, the priors smoothed from host to
domain to top-level suffix to all pages. A page's own text is left out of its
host's, domain's and suffix's counts: it speaks through the likelihood alone.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh, rows_of

#: Labelled documents of each language that the profile may be fitted on, and trigrams kept for each.
SAMPLE_ROWS, TRIGRAMS = 4000, 4000
#: Words after which more text adds no more certainty (trigrams of a text are far from independent).
SURE_WORDS = 60
KAPPA = 5.0
#: Elements that are not part of a page's text, and those that hold its main part.
DROPPED, MAIN = {"script", "style", "nav", "footer", "header", "aside", "noscript"}, {"article", "main"}
# no pattern looks beyond the next bracket, so that unclosed tags cost no second look at the text
_MARK = re.compile(r"<!--|<(/?)([a-z][a-z0-9]*)\b[^<>]*>", re.I)
_AD = re.compile(r"\bclass\s*=\s*[\"']?ad[\"'\s>]", re.I)
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&(#?\w+);")
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)


def main_text(html: str | None) -> str:
    """Visible text of the page's main part, without navigation, scripts and advertising.

    One pass: an element is dropped up to its first closing tag; where there is
    none, only the tag itself goes.
    """
    if not html:
        return ""
    marks = [(m.start(), m.end(), bool(m[1]), (m[2] or "!--").lower(), m) for m in _MARK.finditer(html)]
    closings: dict[str, list[int]] = {}
    for start, end, closes, name, _ in reversed(marks):
        if closes:
            closings.setdefault(name, []).append(start)
    after = {start: end for start, end, closes, _, _ in marks if closes}

    def closing(name: str, at: int) -> int | None:
        left = closings.get(name, [])
        while left and left[-1] < at:
            left.pop()
        return left[-1] if left else None

    everything: list[str] = []
    parts: list[str] = []
    at, inside, no_comment_ends = 0, None, False
    for start, end, closes, name, m in marks:
        if start < at:
            continue
        here = html[at:start]
        everything.append(here)
        if inside:
            parts.append(here)
        at = end
        if name == "!--":
            stop = -1 if no_comment_ends else html.find("-->", end)
            no_comment_ends = stop < 0
            at = end if stop < 0 else stop + 3
        elif closes:
            inside = None if name == inside else inside
        elif name in DROPPED or name == "div" and _AD.search(m[0]):
            stop = closing(name, end)
            at = end if stop is None else after[stop]
        elif name in MAIN and not inside and closing(name, end) is not None:
            inside = name
            parts.append("")
    everything.append(html[at:])
    return _ENTITY.sub(" ", _TAG.sub(" ", " ".join(parts or everything)))


def host_levels(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of an address; empty strings where there is none."""
    m = _HOST.match(url or "")
    if not m:
        return "", "", ""
    host = m[1].lower().strip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def address_hint(url: str | None, languages: list[str]) -> str | None:
    """A language named by the address: its country suffix, first host label, or first path part."""
    host, _, suffix = host_levels(url)
    path = re.sub(r"^[a-z][a-z0-9+.-]*://[^/?#]*", "", url or "", flags=re.I)
    first = path.split("?")[0].split("#")[0].strip("/").split("/")[0].lower()
    return next((x for x in (first, host.split(".")[0], suffix) if x in languages), None)


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


class Profile:
    """Trigram log probabilities by language; trigrams unseen in a language get a floor."""

    def __init__(self, languages: list[str], counts: dict[str, dict[str, int]]):
        self.languages = languages
        grams = sorted({g for c in counts.values() for g in c})
        table = np.array([[counts[lang].get(g, 0) for lang in languages] for g in grams], float).reshape(len(grams), len(languages)) + 0.5
        self.log = dict(zip(grams, np.log(table / table.sum(0)), strict=True)) if grams else {}
        self.words: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        got = self.words.get(w)
        if got is None:
            if len(self.words) >= 200_000:
                self.words.clear()
            got = self.words[w] = sum((self.log[g] for g in trigrams(w) if g in self.log), np.zeros(len(self.languages)))
        return got

    def likelihood(self, text: str) -> np.ndarray:
        ws = words_of(text)
        if not ws:
            return np.zeros(len(self.languages))
        total = np.add.reduce([self.word(w) for w in ws])
        total = total * min(1.0, SURE_WORDS / len(ws))
        return total - total.max()


def fit_profile(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Profile:
    """From the ``sample_rows`` labelled documents of each language with the smallest id hashes, by grouped aggregation."""
    import pyarrow as pa
    from pyspark.sql import Window as W

    ws = Workspace(docs.sparkSession, "langid")
    labelled = fresh(docs, "doc_id", "lang").filter("lang is not null and doc_id is not null")
    order = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1 << 40))
    # rows beyond a bound for their language drop out before any sort
    share = (F.lit(sample_rows) + 4 * F.sqrt(F.lit(float(sample_rows)))) / F.col("n")
    bound = ws.save(labelled.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.least(share, F.lit(1.0)) * (1 << 40)).cast("long").alias("bound")), "bounds")
    near = labelled.join(bound, "lang").withColumn("h", order).filter("h <= bound")
    ids = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= sample_rows).select("doc_id").distinct()
    rows = fresh(docs, "doc_id", "lang", "text").join(F.broadcast(ws.save(ids, "sample")), "doc_id").filter("lang is not null and text is not null")

    def run(batches):
        for b in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in rows_of(b):
                for w in words_of(text):
                    for g in trigrams(w):
                        counts[lang, g] = counts.get((lang, g), 0) + 1
            keys = list(counts)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    top = rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = top.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= TRIGRAMS)
    counts: dict[str, dict[str, int]] = {}
    for r in top.collect():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    return Profile(sorted(counts), counts)


def page_language(pages: DataFrame, profile: Profile) -> DataFrame:
    """(page_id, lang, p_lang, text_lang, declared, address_lang) of each page.

    A page without words is decided by its other evidence. Null html or url give
    no evidence of their kind; null page ids are scored and stay null; repeated
    rows are scored row by row; ties go to the first language by name; without a
    labelled document every language is null; an empty table gives an empty
    result; extra columns are not read.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    ws = Workspace(spark, "langid")
    langs = profile.languages
    kind = pages.schema["page_id"].dataType.simpleString()
    if not langs:
        return fresh(pages, "page_id").selectExpr("page_id", "cast(null as string) lang", "cast(null as double) p_lang", "cast(null as string) text_lang", "cast(null as string) declared", "cast(null as string) address_lang")
    place = {x: k for k, x in enumerate(langs)}
    other, none = len(langs), len(langs) + 1

    def evidence(batches):
        for b in batches:
            out = []
            for i, url, html in rows_of(b):
                ll = profile.likelihood(main_text(html))
                m = _DECLARED.search(html or "")
                declared = m[1].lower() if m else None
                hint = address_hint(url, langs)
                text = int(ll.argmax()) if ll.any() else None
                out.append((i, *host_levels(url), declared, none if declared is None else place.get(declared, other), hint, none if hint is None else place[hint], text, ll.tolist()))
            kinds = [b.schema.field(0).type, *[pa.string()] * 4, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names=["page_id", "host", "domain", "suffix", "declared", "d", "address_lang", "a", "t", "ll"])

    rows = fresh(pages, "page_id", "url", "html").mapInArrow(evidence, f"page_id {kind}, host string, domain string, suffix string, declared string, d int, address_lang string, a int, t int, ll array<double>")
    rows = ws.save(rows, "evidence")

    def given(col: str) -> list[list[float]]:
        """log P(value of col | language), from counts over all pages, add-one smoothed."""
        n = np.ones((none + 1, len(langs)))
        for r in rows.filter("t is not null").groupBy(col, "t").count().collect():
            n[r[col], r.t] += r["count"]
        return np.log(n / n.sum(0)).tolist()

    declared, hints = given("d"), given("a")
    per = F.array(*(F.count_if(F.col("t") == k) for k in range(len(langs))))
    hosts = ws.save(rows.groupBy("host", "domain", "suffix").agg(per.alias("at_host")), "hosts")

    def level(table: DataFrame, keys: list[str], of: str, name: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.array(*(F.sum(F.element_at(of, k + 1)) for k in range(len(langs)))).alias(name))

    domains = ws.save(level(hosts, ["domain", "suffix"], "at_host", "at_domain"), "domains")
    suffixes = ws.save(level(domains, ["suffix"], "at_domain", "at_suffix"), "suffixes")
    n0 = [r or 0 for r in (suffixes.agg(*(F.sum(F.element_at("at_suffix", k + 1)) for k in range(len(langs)))).first())]
    by_host = ws.save(hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "at_host", "at_domain", "at_suffix"), "levels")
    own = F.array(*(F.coalesce((F.col("t") == k).cast("int"), F.lit(0)) for k in range(len(langs))))
    prior = F.array(*(F.lit((n + 1) / (sum(n0) + len(langs))) for n in n0))
    scored = rows.join(by_host, "host").withColumn("own", own).withColumn("prior", prior)
    for name in ("at_suffix", "at_domain", "at_host"):
        # P(l | group) without the page itself, KAPPA pseudo-counts dealt out by the level above
        total = F.aggregate(name, F.lit(0).cast("long"), lambda x, y: x + y) - F.col("t").isNotNull().cast("int") + KAPPA
        scored = scored.withColumn("others", F.zip_with(name, "own", lambda n, o: n - o)).withColumn("prior", F.zip_with("others", "prior", lambda n, p: (n + KAPPA * p) / total))
    score = [
        F.element_at("ll", k + 1) + F.element_at(F.array(*(F.lit(r[k]) for r in declared)), F.col("d") + 1) + F.element_at(F.array(*(F.lit(r[k]) for r in hints)), F.col("a") + 1) + F.log(F.element_at("prior", k + 1))
        for k in range(len(langs))
    ]
    scored = scored.withColumn("s", F.array(*score))
    best = F.array_max("s")
    return scored.select(
        "page_id",
        F.element_at(F.array(*map(F.lit, langs)), F.array_position("s", best).cast("int")).alias("lang"),
        (1 / F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))).alias("p_lang"),
        F.when(F.col("t").isNotNull(), F.element_at(F.array(*map(F.lit, langs)), F.col("t") + 1)).alias("text_lang"),
        "declared",
        "address_lang",
    )


def language_id(spark: SparkSession, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Fit the profile on the labelled documents, decide every page; see ``fit_profile`` and ``page_language``."""
    return page_language(pages, fit_profile(docs))
