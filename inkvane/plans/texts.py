"""Queries over texts: scans, samples, marker tables. Each is one relational text for Spark and DuckDB."""

from __future__ import annotations

from ..functions import lexicons as L
from .dialect import Duck, r, words_in

#: Own sentences that every lexicon of the library occurs in, added by id so that marker queries are not vacuous.
ADDED = [
    "I don't think it's fair -- maybe we should go... They said \"stop\"; I realized I was wrong, and I learned a lot because of it.",
    "Suddenly I felt happy and proud! My friend and I were together, so we laughed; then we walked home. Looking back, it was wonderful.",
    "However, it clearly was a mistake, therefore I'm really sorry. You know, I mean, um, I would like to thank you: thanks.",
    "Perhaps it could rain tomorrow; meanwhile the bright light was gone - and the noise was terrible. Why? Because of this, nobody came.",
    "He shouted and argued with me; that hurt. As a result I was sad, anxious and afraid, but eventually I grew and I changed.",
    "In hindsight it turned out that the team had respect and compassion; years later I came to understand the reason. It was, in summary, good.",
    "She can't, won't and shouldn't blame us: first we ate sweet bread, second we heard music, finally we slept.",
    "Nothing happened here.",
]


#: Hand-made stories with negative ids, of which the markers are known (tests/test_operators.py).
HAND = ["...!", "abc", "a b c d e f g h i j", "a a a a", "don’t it's y'all", "some person"]


def stories(d: Duck) -> str:
    """CTE: (id, source, lang, story), documents with the added sentences and the hand-made ones, dealt by id once."""
    cases = " ".join(f"WHEN {k} THEN {d.s(t)}" for k, t in enumerate(ADDED))
    hand = ", ".join(f"({-1 - k}, 'hand', 'en', {d.s(t)})" for k, t in enumerate(HAND))
    added = f"SELECT doc_id AS id, source, lang, text || ' ' || CASE doc_id % {len(ADDED)} {cases} END AS story FROM documents WHERE text IS NOT NULL"
    return f"stories AS (SELECT {d.near('id')} id, source, lang, story FROM ({added} UNION ALL SELECT * FROM (VALUES {hand}) AS v(id, source, lang, story)) AS u)"


CLITICS = r"n't\b|'(?:s|re|ve|ll|d|m)\b"
TOKEN = r"--|\.\.\.|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
SENTENCE = r"[.!?]+\s+|\n+"
NO_WORD = r"[^\p{L}]+"


def parsed(d: Duck) -> str:
    """CTEs: stories, and parsed (id, source, story, low, clean, toks, n, n_all, sents, n_sents)."""
    return f"""{stories(d)},
    normal AS (SELECT id, source, story, lower(replace(story, '’', '''')) AS low FROM stories),
    cleaned AS (SELECT id, source, story, low, {d.sub('low', CLITICS, ' ')} AS clean FROM normal),
    parts AS (SELECT id, source, story, low, clean, {d.tokens('clean')} AS toks, {d.count('clean', TOKEN)} + {d.count('low', CLITICS)} AS n_all,
        {d.filter(d.split('low', SENTENCE), 's', "trim(s) <> ''")} AS sents FROM cleaned),
    parsed AS (SELECT id, source, story, low, clean, toks, CAST({d.size('toks')} AS DOUBLE) AS n, CAST(n_all AS DOUBLE) AS n_all, sents, CAST({d.size('sents')} AS DOUBLE) AS n_sents FROM parts)"""


def freq(d: Duck) -> str:
    """CTEs up to freq (id, tok, c); a text without words has one row, of no word and count 0."""
    return f"""{parsed(d)},
    toks AS (SELECT id, {d.explode(d.some('toks'))} AS tok FROM parsed),
    freq AS (SELECT id, tok, CAST(count(tok) AS DOUBLE) AS c FROM toks GROUP BY id, tok)"""


def bags(d: Duck) -> str:
    """CTEs up to bags (id, bag): the words of each of an id's texts between blanks, for the functions that count within a row.

    The rows of a partition are sorted to be grouped; lists of words would take several times a text's memory there.
    """
    return f"{parsed(d)}, bags AS (SELECT id, collect_list({d.sub('clean', NO_WORD, ' ')}) AS bag FROM parsed GROUP BY id)"


def counted(d: Duck, function: str) -> str:
    """CTEs up to made (id, w): what a function of ``functions.counted`` makes of the bags."""
    return f"{bags(d)}, made AS (SELECT id, {function}(bag) AS w FROM bags)"


def phrases(d: Duck, kind: str) -> str:
    """Occurrences of the multi-word constructions of a kind, at word borders."""
    return f"CAST({d.count('low', chr(92) + 'b(?:' + '|'.join(L.PHRASES[kind]) + ')' + chr(92) + 'b')} AS DOUBLE)"


def subject_verb(d: Duck, subjects: str, verbs: list[str]) -> str:
    """A subject right before any form of the verbs."""
    forms = "|".join(f for v in verbs for f in L.forms(v))
    return f"CAST({d.count('low', f'{chr(92)}b(?:{subjects}) (?:{forms}){chr(92)}b')} AS DOUBLE)"


def of_words(d: Duck, words: list[str]) -> str:
    return f"CAST({d.size(d.filter('toks', 't', f't IN {words_in(words)}'))} AS DOUBLE)"


def substrings(d: Duck, x: str, needles: list[str]) -> str:
    """Non-overlapping occurrences of each needle, summed; inside words too."""
    return "(" + " + ".join(f"CAST((length({x}) - length(replace({x}, {d.s(n)}, ''))) / {len(n)} AS DOUBLE)" for n in needles) + ")"


def ending(d: Duck, suffixes: list[str]) -> str:
    """The number of words that end in one of the suffixes; for Spark by their last letters, without a pattern for each word."""
    if d.spark:
        last = " OR ".join(f"right(t, {k}) IN {words_in([x for x in suffixes if len(x) == k])}" for k in sorted({len(x) for x in suffixes}))
    else:
        last = d.matches("t", "(" + "|".join(suffixes) + ")$")
    return d.size(d.filter("toks", "t", last))


def of_phrases(d: Duck, kind: str, needles: list[str]) -> str:
    """How many of the phrases a text holds; for Spark all are looked for at once."""
    return f"inkvane_phrases(low).{kind}" if d.spark else present(d, "low", needles, regex=False)


def present(d: Duck, x: str, patterns: list[str], regex: bool = True) -> str:
    one = (lambda p: d.matches(x, p)) if regex else (lambda p: f"(position({d.s(p)} IN {x}) > 0)")
    return "(" + " + ".join(f"CAST({one(p)} AS INT)" for p in patterns) + ")"


N1, S1 = "greatest(n, 1)", "greatest(n_sents, 1)"


def marker_table(columns: dict[str, str]):
    """A query of one row per story from expressions over ``parsed``."""

    def build(d: Duck) -> str:
        cols = ", ".join(f"{r(e)} AS {c}" for c, e in ((c, e(d) if callable(e) else e) for c, e in columns.items()))
        return f"WITH {parsed(d)} SELECT id, {cols} FROM parsed"

    return build


def per_n(e, den="nullif(n, 0)"):
    return lambda d: f"coalesce({e(d)} / {den}, 0)"


words_over = lambda ws, den="nullif(n, 0)", scale="": per_n(lambda d: of_words(d, ws) + scale, den)
both_over = lambda ws, kind, den, scale="": per_n(lambda d: f"({of_words(d, ws)} + {phrases(d, kind)}){scale}", den)
subs_over = lambda ws, den, scale="", x="low": per_n(lambda d: substrings(d, x, ws) + scale, den)
WHITESPACE = r"[^ \t\n\r]+"
SPLIT_WORDS = lambda d: f"nullif({d.count('low', WHITESPACE)}, 0)"


def ratio(a: str, b: str, empty: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE {empty} END"


def scan_filter_words(d):
    return f"""WITH {stories(d)}, counted AS (SELECT id, source, {d.count('story', WHITESPACE)} AS word_count, story FROM stories)
    SELECT id, source, CAST(word_count AS BIGINT) AS word_count FROM counted WHERE word_count BETWEEN 150 AND 1000 AND trim(story) <> ''"""


def stratified_sample(d):
    """Exactly 300 rows in proportion to the sources, by a seeded hash order; topped up or trimmed by the global order.

    No source gives more than 300 rows, so only that many of each leave the tasks.
    """
    h = "md5(CAST(doc_id AS STRING) || ':42')"
    return f"""WITH per AS (SELECT source, count(*) AS per FROM documents GROUP BY source), total AS (SELECT sum(per) AS total FROM per),
    ranked AS (SELECT * FROM (SELECT doc_id AS id, source, {h} AS h, row_number() OVER (PARTITION BY source ORDER BY {h}, doc_id) AS k FROM documents) AS o WHERE k <= 300)
    SELECT id, ranked.source FROM ranked JOIN per ON ranked.source IS NOT DISTINCT FROM per.source CROSS JOIN total
    ORDER BY CASE WHEN k <= round(300.0 * per / total) THEN 0 ELSE 1 END, h, id LIMIT 300"""


def head_n(d):
    return "SELECT doc_id AS id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10"


def semi_manifest(d):
    return "SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def anti_resume(d):
    return "SELECT d.doc_id AS id, d.source FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id" if d.spark else "SELECT d.doc_id AS id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id"


def update_join(d):
    return "SELECT d.doc_id AS id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id"


def todo_mask(d):
    return "SELECT d.doc_id AS id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id WHERE l.quality IS NULL"


def prompt_template(d):
    return f"SELECT conv_id, turn, replace({d.s('Rewrite this story: {text} END')}, '{{text}}', text) AS prompt FROM conversations WHERE role = 'user'"


def jsonl_requests(d):
    """Batch request lines with their nested body, read back field by field."""
    message = d.array([d.struct({"role": "'user'", "content": "text"})])
    line = d.to_json({"custom_id": "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)", "method": "'POST'", "url": "'/v1/chat/completions'", "body": {"model": "'gpt54'", "messages": message, "max_completion_tokens": "turn + 100", "temperature": "0.5"}})
    paths = {"custom_id": "custom_id", "method": "method", "url": "url", "model": "body.model", "role": "body.messages[0].role", "content": "body.messages[0].content", "tokens": "body.max_completion_tokens"}
    return f"WITH q AS (SELECT {line} AS line FROM conversations WHERE role = 'user') SELECT {', '.join(f'{d.json("line", p)} AS {c}' for c, p in paths.items())} FROM q"


def json_response_parse(d):
    """(id, text) of batch response lines without an error; every fifth conversation's line has one."""
    choices = d.array([d.struct({"message": {"content": "text"}})])
    line = d.to_json({"custom_id": "CAST(conv_id * 1000 + turn AS STRING)", "error": "CASE WHEN conv_id % 5 = 0 THEN 'rate limit' END", "response": {"body": {"choices": choices}}})
    return f"""WITH q AS (SELECT {line} AS line FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
    SELECT CAST({d.json('line', 'custom_id')} AS BIGINT) AS id, trim({d.json('line', 'response.body.choices[0].message.content')}) AS text FROM q WHERE {d.json('line', 'error')} IS NULL"""


def event_properties(d):
    return f"SELECT event_id, event_type, trim({d.json('props', 'k')}) AS k, CAST(length(props) AS BIGINT) AS n FROM events WHERE props IS NOT NULL"


def value_counts(d):
    return "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang"


def describe_words(d):
    return f"""WITH {stories(d)}, c AS (SELECT CAST({d.count('story', WHITESPACE)} AS DOUBLE) AS w FROM stories)
    SELECT count(*) AS n, {r('avg(w)')} AS mean, {r('stddev_samp(w)')} AS std, {r('min(w)')} AS min, {r('median(w)')} AS p50, {r('max(w)')} AS max FROM c"""


def union_models(d):
    return """SELECT 'original' AS model, doc_id AS id, n_chars FROM documents UNION ALL
    SELECT 'user' AS model, conv_id AS id, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE role = 'user' UNION ALL
    SELECT 'assistant' AS model, conv_id AS id, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE role = 'assistant'"""


def set_operations(d):
    return """SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a UNION ALL
    SELECT 'either' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) b UNION ALL
    SELECT 'rest' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) c"""


def pivot_rewrites(d):
    """Long to wide: one nullable column for each role."""
    return "SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS text_user, max(CASE WHEN role = 'assistant' THEN text END) AS text_assistant, max(CASE WHEN role = 'system' THEN text END) AS text_system FROM conversations GROUP BY conv_id"


def job_planner(d):
    """Stories x models x conditions not yet done: a bounded list of jobs is expanded within the row."""
    models = d.array([f"'{m}/{c}'" for m in ("gpt54", "claude_sonnet", "gemini_31_pro") for c in ("generic", "rewrite_only", "voice_preserving")])
    done = "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'gpt54/generic' ELSE 'claude_sonnet/generic' END AS job FROM labels"
    return f"WITH jobs AS (SELECT doc_id AS id, {d.explode(models)} AS job FROM documents), done AS ({done}) SELECT job, count(*) AS todo FROM jobs WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.id = jobs.id AND done.job = jobs.job) GROUP BY job"


def entropy(cond: str) -> str:
    """Shannon entropy in bits of the counts c where the condition holds; 0 where there is none."""
    n = f"sum(CASE WHEN {cond} THEN c ELSE 0 END)"
    return f"CASE WHEN {n} > 0 THEN log2({n}) - sum(CASE WHEN {cond} AND c > 0 THEN c * log2(c) ELSE 0 END) / {n} ELSE 0 END"


def char_ngrams(d):
    """Entropy, hapax share and type share of character 2-, 3- and 4-grams, counted together; zero below four characters."""
    text = "text_norm"
    if d.spark:
        cols = ", ".join(f"{r(f'w.{k}{n}')} AS char_{n}gram_{name}" for n in (2, 3, 4) for k, name in (("e", "entropy"), ("h", "hapax_ratio"), ("t", "type_ratio")))
        return f"""WITH {stories(d)}, lowered AS (SELECT id, trim({d.sub('lower(story)', r'[ \t\n\r]+', ' ')}) AS {text} FROM stories),
        made AS (SELECT id, inkvane_char_grams(collect_list({text})) AS w FROM lowered GROUP BY id) SELECT id, {cols} FROM made"""
    grams = f"CASE WHEN length({text}) >= 4 THEN {d.ngrams(text, 4)} ELSE {d.array(['CAST(NULL AS STRING)'])} END"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    cols = []
    for n in (2, 3, 4):
        types, total, once = f"CAST(count_if(g = {n} AND c > 0) AS DOUBLE)", f"sum(CASE WHEN g = {n} THEN c ELSE 0 END)", f"count_if(g = {n} AND c = 1)"
        cols += [(f"char_{n}gram_entropy", entropy(f"g = {n}")), (f"char_{n}gram_hapax_ratio", share(once, types)), (f"char_{n}gram_type_ratio", share(types, total))]
    return f"""WITH {stories(d)}, lowered AS (SELECT id, trim({d.sub('lower(story)', r'[ \t\n\r]+', ' ')}) AS {text} FROM stories),
    grams AS (SELECT id, {d.explode(grams)} AS gram FROM lowered), counts AS (SELECT id, length(gram) AS g, CAST(count(gram) AS DOUBLE) AS c FROM grams GROUP BY id, gram)
    SELECT id, {', '.join(f'{r(e)} AS {c}' for c, e in cols)} FROM counts GROUP BY id"""


def lexical_diversity(d):
    a = "SELECT id, w.n, w.v, w.v1 FROM made" if d.spark else "SELECT id, sum(c) AS n, CAST(count(tok) AS DOUBLE) AS v, count_if(c = 1) AS v1 FROM freq GROUP BY id"
    return f"""WITH {counted(d, 'inkvane_word_counts') if d.spark else freq(d)}, a AS ({a})
    SELECT id, {r('coalesce(v / nullif(n, 0), 0)')} AS ld_ttr, {r('coalesce(v / nullif(sqrt(n), 0), 0)')} AS ld_root_ttr, {r('coalesce(v1 / nullif(v, 0), 0)')} AS ld_hapax_ratio, CAST(v AS BIGINT) AS ld_unique_words, CAST(n AS BIGINT) AS ld_total_words FROM a"""


def textual_entropy(d):
    """Entropies of words, letters and word pairs, counted together under a letter for their kind."""
    if d.spark:
        return f"WITH {counted(d, 'inkvane_unit_entropies')} SELECT id, {', '.join(f'{r(f"w.{k}")} AS ent_{name}' for k, name in (('w', 'word'), ('c', 'char'), ('b', 'bigram')))} FROM made"
    words = d.map("toks", "t", "'w' || t")
    letters = d.map(d.tokens("clean", r"\p{L}"), "c", "'c' || c")
    pairs_ = d.map(d.seq(1, f"greatest({d.size('toks')}, 1)"), "i", "'b' || " + ("get(toks, i - 1) || ' ' || get(toks, i)" if d.spark else "toks[i] || ' ' || toks[i + 1]"))
    cols = ", ".join(f"{r(entropy(f'kind = {chr(39)}{k}{chr(39)}'))} AS ent_{name}" for k, name in (("w", "word"), ("c", "char"), ("b", "bigram")))
    return f"""WITH {parsed(d)}, units AS (SELECT id, {d.explode(d.cat([words, letters, pairs_]))} AS tok FROM parsed),
    counts AS (SELECT id, left(tok, 1) AS kind, CAST(count(tok) AS DOUBLE) AS c FROM units GROUP BY id, tok) SELECT id, {cols} FROM counts GROUP BY id"""


def mtld(d):
    """Mean of a forward and a backward pass: a segment closes at a type-token ratio of 0.72, the tail counts in part.

    A word is new in its segment if its last occurrence lies before the segment,
    so the pass is a fold over those places.
    """
    if d.spark:
        return f"WITH {parsed(d)} SELECT id, {r('inkvane_mtld(toks)')} AS ld_mtld FROM parsed"
    left = d.fold("prev", {"f": 0, "lo": 1, "types": 0, "i": 0}, "s", "p", {"f": f"s.f + {CLOSED}", "lo": f"CASE WHEN {CLOSED} = 1 THEN s.i + 2 ELSE s.lo END", "types": f"CASE WHEN {CLOSED} = 1 THEN 0 ELSE {TYPES} END", "i": "s.i + 1"})
    tail = lambda s: f"({s}.f + CASE WHEN n > {s}.lo AND {s}.types < n - {s}.lo + 1 THEN (1 - {s}.types / (n - {s}.lo + 1)) / 0.28 ELSE 0 END)"
    score = lambda s: f"CASE WHEN {tail(s)} > 0 THEN n / {tail(s)} ELSE n END"
    at = f"SELECT id, n, unnest(range(1, greatest({d.size('toks')}, 1) + 1)) AS pos, unnest({d.some('toks')}) AS tok FROM parsed"
    return f"""WITH {parsed(d)}, places AS ({at}),
    seen AS (SELECT id, n, pos, coalesce(lag(pos) OVER (PARTITION BY id, tok ORDER BY pos), 0) AS p, coalesce(n + 1 - lead(pos) OVER (PARTITION BY id, tok ORDER BY pos), 0) AS q, tok FROM places),
    lists AS (SELECT id, n, {d.gather('CAST(p AS DOUBLE)', 'tok IS NOT NULL', 'pos')} AS prev, {d.gather('CAST(q AS DOUBLE)', 'tok IS NOT NULL', '-pos')} AS next FROM seen GROUP BY id, n),
    folded AS (SELECT id, n, {left} AS a, {left.replace('prev', 'next', 1)} AS b FROM lists)
    SELECT id, {r(f'({score("a")} + {score("b")}) / 2')} AS ld_mtld FROM folded"""


TYPES = "(s.types + CASE WHEN p < s.lo THEN 1 ELSE 0 END)"
CLOSED = f"(CASE WHEN {TYPES} / (s.i + 2 - s.lo) <= 0.72 THEN 1 ELSE 0 END)"


def mfw_profile(d):
    if d.spark:
        of = lambda e: r(f"coalesce({e} / nullif(w.n, 0), 0)")
        fw = d.sumlist("w.fw")
        return f"""WITH {counted(d, 'inkvane_word_counts')} SELECT id, {of('w.top10')} AS mfw_top10_coverage, {of('w.top50')} AS mfw_top50_coverage,
        {r('CASE WHEN w.size > 1 THEN 2 * w.ranked / (w.size * w.n) - (w.size + 1) / w.size ELSE 0 END')} AS mfw_concentration, {of(fw)} AS mfw_fw_ratio FROM made"""
    share = lambda e: r(f"coalesce({e} / nullif(sum(c), 0), 0)")
    return f"""WITH {freq(d)}, ranked AS (SELECT id, tok, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, tok) AS k, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS i FROM freq)
    SELECT id, {share('sum(CASE WHEN k <= 10 THEN c ELSE 0 END)')} AS mfw_top10_coverage, {share('sum(CASE WHEN k <= 50 THEN c ELSE 0 END)')} AS mfw_top50_coverage,
    {r('CASE WHEN count(*) > 1 THEN 2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) ELSE 0 END')} AS mfw_concentration,
    {share(f'sum(CASE WHEN tok IN {words_in(L.TOP_FUNCTION_WORDS)} THEN c ELSE 0 END)')} AS mfw_fw_ratio FROM ranked GROUP BY id"""


def mfw_frequencies(d):
    if d.spark:
        cols = ", ".join(f"{r(f'coalesce(1000 * w.fw[{k}] / nullif(w.n, 0), 0)')} AS mfw_{w}" for k, w in enumerate(L.TOP_FUNCTION_WORDS))
        return f"WITH {counted(d, 'inkvane_word_counts')} SELECT id, {cols} FROM made"
    cols = ", ".join(f"{r(f'coalesce(1000 * sum(CASE WHEN tok = {chr(39)}{w}{chr(39)} THEN c ELSE 0 END) / nullif(sum(c), 0), 0)')} AS mfw_{w}" for w in L.TOP_FUNCTION_WORDS)
    return f"WITH {freq(d)} SELECT id, {cols} FROM freq GROUP BY id"


def vocab_richness(d):
    a = "SELECT id, w.n, w.v, w.v1, w.v2, w.m2, w.m2 - w.n AS m1 FROM made" if d.spark else "SELECT id, sum(c) AS n, CAST(count(tok) AS DOUBLE) AS v, CAST(count_if(c = 1) AS DOUBLE) AS v1, CAST(count_if(c = 2) AS DOUBLE) AS v2, sum(c * c) AS m2, sum(c * (c - 1)) AS m1 FROM freq GROUP BY id"
    return f"""WITH {counted(d, 'inkvane_word_counts') if d.spark else freq(d)}, a AS ({a})
    SELECT id, {r('CASE WHEN n < 2 THEN 0 ELSE 10000 * (m2 - n) / (n * n) END')} AS vocab_yules_k, {r('CASE WHEN n < 2 THEN 0 ELSE m1 / (n * (n - 1)) END')} AS vocab_simpsons_d,
    {r('CASE WHEN n < 2 OR v1 = v THEN 0 ELSE 100 * ln(n) / (1 - v1 / v) END')} AS vocab_honores_r, {r('CASE WHEN n < 2 THEN 0 ELSE v2 / v END')} AS vocab_sichels_s, {r('CASE WHEN n < 2 THEN 0 ELSE power(n, power(v, -0.172)) END')} AS vocab_brunets_w FROM a"""


def word_length_dist(d):
    if d.spark:
        cols = ", ".join(f"{r(f'coalesce(w.by[{k - 1}] / nullif(w.n, 0), 0)')} AS wlen_{k}" for k in range(1, 16))
        return f"""WITH {counted(d, 'inkvane_word_lengths')} SELECT id, {cols}, {r('w.mu')} AS wlen_mean, {r('coalesce(sqrt(w.m2 / nullif(w.n, 0)), 0)')} AS wlen_std,
        {r('CASE WHEN w.m2 > 0.000000001 THEN (w.m3 / w.n) / power(w.m2 / w.n, 1.5) ELSE 0 END')} AS wlen_skew FROM made"""
    cols = ", ".join(f"{r(f'coalesce(sum(CASE WHEN l = {k} THEN c ELSE 0 END) / nullif(sum(c), 0), 0)')} AS wlen_{k}" for k in range(1, 16))
    return f"""WITH {freq(d)}, lens AS (SELECT id, CAST(length(tok) AS DOUBLE) AS l, c FROM freq), m AS (SELECT id, sum(l * c) / nullif(sum(c), 0) AS mu FROM lens GROUP BY id),
    cent AS (SELECT lens.id, l, c, mu, l - mu AS e FROM lens JOIN m ON lens.id = m.id)
    SELECT id, {cols}, {r('coalesce(max(mu), 0)')} AS wlen_mean, {r('coalesce(sqrt(sum(c * e * e) / nullif(sum(c), 0)), 0)')} AS wlen_std,
    {r('CASE WHEN sum(c * e * e) > 0.000000001 THEN (sum(c * e * e * e) / sum(c)) / power(sum(c * e * e) / sum(c), 1.5) ELSE 0 END')} AS wlen_skew FROM cent GROUP BY id"""


PUNCT = {"comma": [","], "semicolon": [";"], "colon": [":"], "dash": ["-", "—", "–"], "exclamation": ["!"], "question": ["?"], "quote": ['"', "'", '"', '"'], "ellipsis": ["...", "…"]}
punct = lambda k, den: subs_over(PUNCT[k], den, x="story")
ALL_PUNCT = [x for v in PUNCT.values() for x in v]
punct_patterns = marker_table({f"punct_{k}_ratio": punct(k, "nullif(n_all, 0)") for k in PUNCT} | {"punct_total_ratio": subs_over(ALL_PUNCT, "nullif(n_all, 0)", x="story"), "punct_per_sentence": subs_over(ALL_PUNCT, S1, x="story")})


def lengths(d: Duck) -> str:
    """CTEs up to le (id, l): words of each sentence, null for sentences and texts without any."""
    return f"""{parsed(d)}, se AS (SELECT id, {d.explode(d.some('sents'))} AS s FROM parsed), le AS (SELECT id, nullif(CAST({d.count(d.sub('s', CLITICS, ' '), chr(92) + 'p{L}+')} AS DOUBLE), 0) AS l FROM se)"""


def sent_length_dist(d):
    cols = {"mean": "avg(l)", "std": "stddev_pop(l)", "median": "median(l)", "min": "min(l)", "max": "max(l)", "range": "max(l) - min(l)", "short_ratio": "avg(CASE WHEN l < 10 THEN 1 WHEN l >= 10 THEN 0 END)", "long_ratio": "avg(CASE WHEN l > 25 THEN 1 WHEN l <= 25 THEN 0 END)", "variation_coef": "stddev_pop(l) / avg(l)"}
    return f"WITH {lengths(d)} SELECT id, {', '.join(f'{r(f"coalesce({e}, 0)")} AS slen_{k}' for k, e in cols.items())} FROM le GROUP BY id"


def sentence_lengths(d):
    """The length markers of syntactic complexity; the others need a parser (``syntax_markers``)."""
    cols = {"mean": "avg(l)", "std": "stddev_pop(l)", "max": "max(l)", "min": "min(l)"}
    return f"WITH {lengths(d)}, n AS (SELECT id, n_sents FROM parsed) SELECT le.id, {', '.join(f'{r(f"coalesce({e}, 0)")} AS syn_{k}_sent_len' for k, e in cols.items())}, {r('max(n_sents)')} AS syn_n_sents FROM le JOIN n ON le.id = n.id GROUP BY le.id"


def fw_freqs(d):
    """CTEs up to fw (id, tok, f): relative frequencies of the function words that a text holds, one row of no word where there is none."""
    return f"""{parsed(d)}, ft AS (SELECT id, n, {d.explode(d.some(d.filter('toks', 't', f't IN {words_in(L.TOP_FUNCTION_WORDS)}')))} AS tok FROM parsed),
    fw AS (SELECT id, tok, CAST(count(tok) AS DOUBLE) / greatest(n, 1) AS f FROM ft GROUP BY id, n, tok)"""


WORDS_50 = float(len(L.TOP_FUNCTION_WORDS))


def delta_features(d):
    """Over the 50 function words; those that a text lacks have frequency 0."""
    total = lambda e, absent: f"({d.sumlist(d.map('fs', 'f', e))} + ({WORDS_50} - {d.size('fs')}) * {absent})"
    return f"""WITH {fw_freqs(d)}, g AS (SELECT id, {d.gather('f', 'tok IS NOT NULL')} AS fs FROM fw GROUP BY id), m AS (SELECT id, fs, {d.sumlist('fs')} / {WORDS_50} AS mu FROM g),
    v AS (SELECT id, fs, mu, sqrt({total('(f - mu) * (f - mu)', 'mu * mu')} / {WORDS_50}) AS sd FROM m)
    SELECT id, {r(f"coalesce({total('abs(f - mu)', 'mu')} / {WORDS_50} / nullif(sd, 0), 0)")} AS delta_fw_zscore_mean, {r('CASE WHEN sd > 0 THEN 1.0 ELSE 0.0 END')} AS delta_fw_zscore_std, {r(total('abs(f - 0.02)', '0.02'))} AS delta_fw_deviation FROM v"""


def delta_distance(d):
    """Mean absolute z distance to the whole corpus as the reference; a word that a text lacks lies at -mu / sd."""
    return f"""WITH {fw_freqs(d)}, docs AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS docs FROM fw), sums AS (SELECT tok, sum(f) AS s1, sum(f * f) AS s2 FROM fw WHERE tok IS NOT NULL GROUP BY tok),
    ref AS (SELECT tok, s1 / docs AS mu, coalesce(nullif(sqrt(greatest((s2 - s1 * s1 / docs) / docs, 0)), 0), 1) AS sd FROM sums CROSS JOIN docs), lacking AS (SELECT coalesce(sum(mu / sd), 0) AS lacking FROM ref)
    SELECT fw.id, {r(f'(sum(CASE WHEN ref.tok IS NULL THEN 0 ELSE abs((f - mu) / sd) - mu / sd END) + max(lacking)) / {WORDS_50}')} AS delta_distance FROM fw LEFT JOIN ref ON fw.tok = ref.tok CROSS JOIN lacking GROUP BY fw.id"""


SYLLABLES = lambda d: d.count("clean", "[aeiouy]+")
LETTERS = lambda d: d.count("clean", r"\p{L}")
COMPLEX = lambda d: d.size(d.filter("toks", "t", d.count("t", "[aeiouy]+") + " >= 3"))
readability = marker_table(
    {
        "read_flesch_ease": lambda d: f"206.835 - 1.015 * n / {S1} - 84.6 * {SYLLABLES(d)} / {N1}",
        "read_flesch_kincaid": lambda d: f"0.39 * n / {S1} + 11.8 * {SYLLABLES(d)} / {N1} - 15.59",
        "read_gunning_fog": lambda d: f"0.4 * (n / {S1} + 100.0 * {COMPLEX(d)} / {N1})",
        "read_coleman_liau": lambda d: f"0.0588 * 100 * {LETTERS(d)} / {N1} - 0.296 * 100 * n_sents / {N1} - 15.8",
        "read_ari": lambda d: f"4.71 * {LETTERS(d)} / {N1} + 0.5 * n / {S1} - 21.43",
        "read_syllables_per_word": lambda d: f"{SYLLABLES(d)} / {N1}",
    }
)
stylometric_features = marker_table(
    {
        "sty_function_word_ratio": words_over(L.FUNCTION_WORDS, "nullif(n_all, 0)"),
        "sty_punct_ratio": per_n(lambda d: d.count("clean", r"--|\.\.\.|[^\s\p{L}\p{N}]"), "nullif(n_all, 0)"),
        "sty_mean_word_length": per_n(LETTERS),
        "sty_exclamation_per_sent": subs_over(["!"], S1),
        "sty_question_per_sent": subs_over(["?"], S1),
    }
)
moral_reflective = marker_table(
    {f"moral_{k}": words_over(v) for k, v in L.MORAL.items()}
    | {
        "reflective_markers": per_n(lambda d: f"100.0 * {present(d, 'low', L.REFLECTIVE)}"),
        "causal_markers": subs_over(L.CAUSAL_SUBSTRINGS, "nullif(n, 0)", " * 100"),
        "growth_markers": per_n(lambda d: f"100.0 * {present(d, 'low', L.GROWTH)}"),
    }
)
authenticity_voice = marker_table(
    {
        "voice_first_person_density": words_over(L.FIRST_PERSON, "nullif(n_all, 0)"),
        "voice_disfluency": lambda d: f"coalesce({substrings(d, 'low', L.DISFLUENCIES)} / {SPLIT_WORDS(d)}, 0)",
        "voice_contraction_density": per_n(lambda d: d.count("low", r"n't|'re|'ve|'ll|'d|'m|'s"), "nullif(n_all, 0)"),
        "voice_specific_number_density": per_n(lambda d: d.count("clean", r"\p{N}+"), "nullif(n_all, 0)"),
    }
)
conflict_blame = marker_table(
    {
        "conflict_verb_density": words_over(L.CONFLICT_VERBS),
        "conflict_blame_density": lambda d: f"coalesce({substrings(d, 'low', L.NEGATIVE_ATTRIBUTION)} / {SPLIT_WORDS(d)}, 0)",
        "conflict_second_person": words_over(L.SECOND_PERSON_BLAME),
    }
)
temporal_markers = marker_table({"narr_temporal_marker_density": lambda d: f"coalesce(CAST({d.size(d.filter(d.tokens('low', WHITESPACE), 't', f't IN {words_in(L.TEMPORAL_MARKERS)}'))} AS DOUBLE) / {SPLIT_WORDS(d)}, 0)"})
discourse_connectives = marker_table({"coh_connective_density": lambda d: f"CASE WHEN {d.size(d.filter('sents', 's', 'length(trim(s)) > 10'))} < 2 THEN 0 ELSE {substrings(d, 'low', L.CONNECTIVES)} / {d.size(d.filter('sents', 's', 'length(trim(s)) > 10'))} END"})
UNSURE, SURE = (lambda d: f"({of_words(d, L.UNCERTAINTY)} + {phrases(d, 'hedges')})"), (lambda d: f"({of_words(d, L.CERTAINTY)} + {phrases(d, 'certainty')})")
stance_epistemic = marker_table(
    {
        "idx_hedge_density": both_over(L.HEDGES, "hedges", S1),
        "idx_booster_density": both_over(L.BOOSTERS, "boosters", S1),
        "idx_epistemic_construction_density": per_n(lambda d: f"({subject_verb(d, 'i|we', L.EPISTEMIC_VERBS)} + {subject_verb(d, 'it', L.SEEMING_VERBS)})", S1),
        "idx_certainty_ratio": per_n(SURE, S1),
        "idx_uncertainty_ratio": per_n(UNSURE, S1),
        "idx_certainty_uncertainty_ratio": lambda d: ratio(SURE(d), UNSURE(d), f"CASE WHEN {SURE(d)} > 0 THEN 1.0 ELSE 0.0 END"),
    }
)
#: Sentences that begin with a discourse marker.
INITIAL = lambda d: f"CAST({d.size(d.filter('sents', 's', d.matches('s', '^[^a-z]*(?:' + '|'.join(L.INITIAL_DISCOURSE) + ')' + chr(92) + 'b')))} AS DOUBLE)"
stance_involvement = marker_table(
    {
        "idx_first_person_singular": words_over(L.FIRST_SINGULAR, N1, " * 100"),
        "idx_first_person_plural": words_over(L.FIRST_PLURAL, N1, " * 100"),
        "idx_second_person": words_over(L.SECOND_PERSON, N1, " * 100"),
        "idx_discourse_marker_density": per_n(lambda d: f"({INITIAL(d)} + {phrases(d, 'discourse_parenthetical')})", S1),
        "idx_question_density": subs_over(["?"], S1),
        "idx_exclamation_density": subs_over(["!"], S1),
        "idx_direct_speech_density": lambda d: f"floor({substrings(d, 'low', [chr(34)])} / 2) / {S1}",
    }
)
REPEATS = lambda d: d.size(d.filter(d.seq(2, f"greatest({d.size('toks')}, 2)"), "i", "toks[i - 1] = toks[i - 2]" if d.spark else "toks[i] = toks[i - 1]"))
stance_orality = marker_table(
    {
        "idx_contraction_density": per_n(lambda d: f"100.0 * {d.count('lower(story)', chr(92) + 'b(?:[a-z]+n' + chr(39) + 't|[a-z]+' + chr(39) + '(?:m|re|ve|ll|d|s)|gonna|wanna|gotta|kinda|sorta|dunno|y' + chr(39) + 'all)' + chr(92) + 'b')}", N1),
        "idx_repetition_ratio": lambda d: f"CASE WHEN n > 1 THEN 100.0 * {REPEATS(d)} / n ELSE 0 END",
        "idx_clause_chaining": words_over(L.COORDINATORS, S1),
        "idx_em_dash_density": subs_over(["—", "--"], S1, x="story"),
        "idx_comma_density": subs_over([","], S1),
        "idx_semicolon_density": subs_over([";"], S1),
        "idx_nominalization_ratio": per_n(lambda d: f"100.0 * {ending(d, L.NOMINAL_SUFFIXES)}", N1),
        "idx_mean_word_length": per_n(LETTERS),
        "idx_complex_word_ratio": per_n(lambda d: f"100.0 * {d.size(d.filter('toks', 't', 'length(t) > 6'))}", N1),
    }
)
stance_temporal_causal = marker_table(
    {
        "idx_temporal_connective_density": both_over(L.TEMPORAL, "temporal", S1),
        "idx_causal_connective_density": both_over(L.CAUSAL, "causal", S1),
        "idx_evaluative_density": both_over(L.EVALUATIVE, "evaluative", S1),
        "idx_closure_marker_density": per_n(lambda d: f"({phrases(d, 'closure')} + {subject_verb(d, 'i|we', L.CLOSURE_VERBS)})", S1),
        "idx_narrative_sequencing": words_over(L.SEQUENCING, S1),
    }
)
stance_affect = marker_table(
    {
        "idx_positive_affect": words_over(L.POSITIVE, N1, " * 100"),
        "idx_negative_affect": words_over(L.NEGATIVE, N1, " * 100"),
        "idx_affect_balance": lambda d: ratio(f"{of_words(d, L.POSITIVE)} - {of_words(d, L.NEGATIVE)}", f"{of_words(d, L.POSITIVE)} + {of_words(d, L.NEGATIVE)}", "0"),
        "idx_interpersonal_density": both_over(L.INTERPERSONAL, "interpersonal", S1),
        "idx_moral_framing_density": both_over(L.MORAL_FRAMING, "moral", S1),
    }
)
stance_experiential = marker_table(
    {
        "idx_sensory_language_density": words_over(sorted({w for ws in L.SENSORY.values() for w in ws}), S1),
        "idx_retrospective_framing_density": per_n(lambda d: f"({of_phrases(d, 'retrospective', L.RETROSPECTIVE_PHRASES)} + {of_words(d, L.RETROSPECTIVE_TOKENS)})", S1),
        "idx_causal_explanatory_density": per_n(lambda d: f"({of_words(d, L.CAUSAL_EXPLANATORY)} + {of_phrases(d, 'causal', L.CAUSAL_PHRASES)})", S1),
        "idx_abstraction_density": per_n(lambda d: f"100.0 * {ending(d, L.ABSTRACT_SUFFIXES)}", N1),
    }
)
EMOTION_WORDS = sorted({w for ws in L.EMOTIONS.values() for w in ws})


def emotional_dynamics(d):
    counts = {k: of_words(d, v) for k, v in L.EMOTIONS.items()}
    per = d.map("sents", "s", f"CAST({d.size(d.filter(d.tokens('s'), 't', f't IN {words_in(EMOTION_WORDS)}'))} AS DOUBLE)")
    cols = ", ".join(f"{e} AS c_{k}" for k, e in counts.items())
    total = " + ".join(f"c_{k}" for k in counts)
    entropy = " - ".join(["0"] + [f"CASE WHEN c_{k} > 0 THEN c_{k} / tot * log2(c_{k} / tot) ELSE 0 END" for k in counts])
    distinct = " + ".join(f"CASE WHEN c_{k} > 0 THEN 1 ELSE 0 END" for k in counts)
    return f"""WITH {parsed(d)}, c AS (SELECT id, n, {of_words(d, EMOTION_WORDS)} AS hits, {per} AS per, {cols} FROM parsed), t AS (SELECT *, nullif({total}, 0) AS tot, {d.sumlist('per')} / nullif({d.size('per')}, 0) AS mu FROM c)
    SELECT id, {r(f'CASE WHEN tot IS NULL THEN 0 ELSE {entropy} END')} AS emo_granularity, {r(f"CASE WHEN {d.size('per')} > 1 THEN sqrt({d.sumlist(d.map('per', 'p', '(p - mu) * (p - mu)'))} / {d.size('per')}) ELSE 0 END")} AS emo_volatility,
    {r('coalesce(hits / nullif(n, 0), 0)')} AS emo_word_density, CAST({distinct} AS BIGINT) AS emo_distinct_emotions FROM t"""


def sentiment_affect(d):
    """Valence s / sqrt(s*s + 15) of sentences of three words or more, with the own lexicon; zeros where there is none."""
    cols = {"mean_compound": "avg(x)", "std_compound": "stddev_pop(x)", "min_compound": "min(x)", "max_compound": "max(x)", "range_compound": "max(x) - min(x)", "pct_positive": "avg(CASE WHEN x > 0.05 THEN 1 WHEN x <= 0.05 THEN 0 END)", "pct_negative": "avg(CASE WHEN x < -0.05 THEN 1 WHEN x >= -0.05 THEN 0 END)"}
    value = f"1.9 * ({d.size(d.filter('toks', 't', f't IN {words_in(L.POSITIVE)}'))} - {d.size(d.filter('toks', 't', f't IN {words_in(L.NEGATIVE)}'))})"
    return f"""WITH {parsed(d)}, se AS (SELECT id, {d.explode(d.some('sents'))} AS s FROM parsed), st AS (SELECT id, {d.tokens('s')} AS toks FROM se), sv AS (SELECT id, CASE WHEN {d.size('toks')} >= 3 THEN CAST({value} AS DOUBLE) END AS v FROM st),
    c AS (SELECT id, v / sqrt(v * v + 15) AS x FROM sv)
    SELECT id, {', '.join(f'{r(f"coalesce({e}, 0)")} AS sent_{k}' for k, e in cols.items())} FROM c GROUP BY id"""


def sentence_cohesion(d):
    """Word overlap (cosine of word sets) of adjacent sentences and of all pairs; zeros below two sentences of over two words.

    All pairs by their closed form: the squared length of the sum of the
    sentences' unit vectors, less their number. For Spark both are counted within
    a row: no row for each word of a sentence is made.
    """
    if d.spark:
        words = d.sub(d.sub("low", SENTENCE, "\n"), r"[^\p{L}\n]+", " ")
        local, apart = "total / (k - 1)", "1 - least"
        one = lambda e: r(f"CASE WHEN k >= 2 THEN {e} ELSE 0 END")
        return f"""WITH {parsed(d)}, bags AS (SELECT id, collect_list({words}) AS bag FROM parsed GROUP BY id), made AS (SELECT id, inkvane_cohesion(bag) AS w FROM bags),
        al AS (SELECT id, w.u2 AS u2, inline(w.of) FROM made)
        SELECT id, {one(local)} AS coh_local_similarity, {one('(u2 - k) / (k * (k - 1))')} AS coh_global_similarity, {one(f'1 - {local}')} AS sd_mean_consecutive, {one(apart)} AS sd_max_consecutive FROM al"""
    one, two = ("ws[i - 2]", "ws[i - 1]") if d.spark else ("ws[i - 1]", "ws[i]")
    sim = f"CAST({d.size(d.both(one, two))} AS DOUBLE) / sqrt(CAST({d.size(one)} AS DOUBLE) * {d.size(two)})"
    sims = f"CASE WHEN {d.size('ws')} >= 2 THEN {d.map(d.seq(2, f'greatest({d.size("ws")}, 2)'), 'i', sim)} ELSE {d.array(['CAST(1 AS DOUBLE)'])} END"
    weights = d.map("ws", "w", d.map("w", "t", f"t || ' ' || CAST({d.size('w')} AS STRING)"))
    flat = f"flatten({weights})"
    many = "k >= 2"
    return f"""WITH {parsed(d)}, se AS (SELECT id, {d.filter(d.map('sents', 's', d.distinct(d.tokens('s'))), 'w', f"{d.size('w')} > 2")} AS ws FROM parsed),
    sim AS (SELECT id, CAST({d.size('ws')} AS DOUBLE) AS k, {sims} AS sims FROM se), wt AS (SELECT id, {d.explode(d.some(flat))} AS t FROM se),
    wc AS (SELECT id, split_part(t, ' ', 1) AS tok, sum(1 / sqrt(CAST(split_part(t, ' ', 2) AS DOUBLE))) AS u FROM wt GROUP BY id, split_part(t, ' ', 1)), al AS (SELECT id, coalesce(sum(u * u), 0) AS u2 FROM wc GROUP BY id)
    SELECT sim.id, {r(f"CASE WHEN {many} THEN {d.sumlist('sims')} / (k - 1) ELSE 0 END")} AS coh_local_similarity, {r(f'CASE WHEN {many} THEN (u2 - k) / (k * (k - 1)) ELSE 0 END')} AS coh_global_similarity,
    {r(f"CASE WHEN {many} THEN 1 - {d.sumlist('sims')} / (k - 1) ELSE 0 END")} AS sd_mean_consecutive, {r(f"CASE WHEN {many} THEN 1 + {d.top(d.map('sims', 'x', '-x'))} ELSE 0 END")} AS sd_max_consecutive FROM sim JOIN al ON sim.id = al.id"""


QUERIES = {f.__name__: f for f in (scan_filter_words, stratified_sample, head_n, semi_manifest, anti_resume, update_join, todo_mask, prompt_template, jsonl_requests, json_response_parse, event_properties, value_counts, describe_words, union_models, set_operations, pivot_rewrites, job_planner, char_ngrams, lexical_diversity, mtld, textual_entropy, mfw_profile, mfw_frequencies, vocab_richness, word_length_dist, sent_length_dist, sentence_lengths, delta_features, delta_distance, emotional_dynamics, sentiment_affect, sentence_cohesion)} | {
    "punct_patterns": punct_patterns, "readability": readability, "stylometric_features": stylometric_features, "moral_reflective": moral_reflective, "authenticity_voice": authenticity_voice, "conflict_blame": conflict_blame, "temporal_markers": temporal_markers,
    "discourse_connectives": discourse_connectives, "stance_epistemic": stance_epistemic, "stance_involvement": stance_involvement, "stance_orality": stance_orality, "stance_temporal_causal": stance_temporal_causal, "stance_affect": stance_affect, "stance_experiential": stance_experiential,
}
