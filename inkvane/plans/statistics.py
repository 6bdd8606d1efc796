"""Queries over pairs: paired statistics, reliability, distances and reports. One relational text for both engines."""

from __future__ import annotations

from ..functions import lexicons as L
from . import texts
from .dialect import Duck, Spark, r, upper_tail, words_in

#: Markers of the paired comparison, over (x, low, toks, n, n_sents, letters) of one text.
COMPARED = [
    "ld_total_words", "ld_unique_words", "ld_ttr", "sty_mean_word_length", "sty_function_word_ratio", "punct_comma_ratio", "punct_total_ratio", "slen_mean", "syn_n_sents", "wlen_long_ratio", "wlen_short_ratio", "read_ari", "read_coleman_liau", "vocab_repeat_ratio", "mfw_the_ratio", "char_vowel_ratio",
]
# The dimension of a marker by its prefix; anything else is "other".
DIMENSIONS = {"ld": "lexical_diversity", "syn": "syntactic_complexity", "sd": "semantic_distance", "ent": "textual_entropy", "sent": "sentiment_affect", "coh": "discourse_cohesion", "sty": "stylometric", "pos": "stylometric", "read": "readability"}
CONDITIONS = ["generic", "rewrite_only", "voice_preserving"]
MODELS = ["gpt54", "claude_sonnet", "gemini_31_pro"]


def pairs(d: Duck) -> str:
    """CTE: (id, condition, model, orig, rewrite), a user turn and the assistant turn after it; synthetic labels by id."""
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    case = lambda e, names: f"CASE {e} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    third = "CAST(floor(conv_id / 3.0) AS BIGINT) % 3"
    return f"""turns AS (SELECT conv_id, turn, role, text, lead(text) {w} AS nt, lead(role) {w} AS nr FROM conversations),
    pairs AS (SELECT conv_id * 1000 + turn AS id, {case('conv_id % 3', CONDITIONS)} AS condition, {case(third, MODELS)} AS model, text AS orig, nt AS rewrite FROM turns WHERE role = 'user' AND nr = 'assistant')"""


def long(d: Duck) -> str:
    """CTEs up to long (id, condition, model, marker, o, w): each marker of both texts; a missing side drops the pair."""

    def table(name: str, x: str) -> str:
        vals = {
            "ld_total_words": "n", "ld_unique_words": "v", "ld_ttr": "v / n", "sty_mean_word_length": "letters / n",
            "sty_function_word_ratio": f"CAST({d.size(d.filter('toks', 't', f't IN {words_in(L.FUNCTION_WORDS)}'))} AS DOUBLE) / n",
            "punct_comma_ratio": f"{d.count('low', ',')} / n", "punct_total_ratio": f"{d.count('low', '[.,!?;:]')} / n", "slen_mean": "n / s", "syn_n_sents": "s",
            "wlen_long_ratio": f"{d.size(d.filter('toks', 't', 'length(t) > 6'))} / n", "wlen_short_ratio": f"{d.size(d.filter('toks', 't', 'length(t) <= 3'))} / n",
            "read_ari": "4.71 * letters / n + 0.5 * n / s - 21.43", "read_coleman_liau": "5.88 * letters / n - 29.6 * s / n - 15.8", "vocab_repeat_ratio": "(n - v) / n",
            "mfw_the_ratio": f"{d.size(d.filter('toks', 't', chr(116) + ' = ' + chr(39) + 'the' + chr(39)))} / n", "char_vowel_ratio": f"{d.count('low', '[aeiou]')} / letters",
        }
        cols = ", ".join(f"{vals[c]} AS {c}" for c in COMPARED)
        return f"""{name}_a AS (SELECT {d.near('id')} id, condition, model, lower({x}) AS low FROM pairs WHERE {x} IS NOT NULL),
        {name}_b AS (SELECT id, condition, model, low, {d.tokens('low')} AS toks, greatest({d.size(d.filter(d.split('low', '[.!?]+' + chr(92) + 's+|' + chr(92) + 'n+'), 's', "trim(s) <> ''"))}, 1) AS s1 FROM {name}_a),
        {name}_c AS (SELECT id, condition, model, low, toks, nullif(CAST({d.size('toks')} AS DOUBLE), 0) AS n, CAST({d.size(d.distinct('toks'))} AS DOUBLE) AS v, CAST(s1 AS DOUBLE) AS s, nullif(CAST({d.count('low', chr(92) + 'p{L}')} AS DOUBLE), 0) AS letters FROM {name}_b),
        {name}_d AS (SELECT id, condition, model, {cols} FROM {name}_c),
        {name} AS (SELECT id, condition, model, {d.unpivot(COMPARED)} FROM {name}_d)"""

    return f"""{pairs(d)}, {table('lo', 'orig')}, {table('lw', 'rewrite')},
    long AS (SELECT lo.id, lo.condition, lo.model, lo.marker, round(lo.value, 9) AS o, round(lw.value, 9) AS w FROM lo JOIN lw ON lo.id = lw.id AND lo.marker = lw.marker WHERE lo.value IS NOT NULL AND lw.value IS NOT NULL)"""


#: Marker tables of both sides of a pair, with the columns taken from each.
TABLES = {
    "lexical_diversity": ["ld_ttr", "ld_root_ttr", "ld_hapax_ratio", "ld_unique_words", "ld_total_words"],
    "mtld": ["ld_mtld"],
    "textual_entropy": ["ent_word", "ent_char", "ent_bigram"],
    "sentence_lengths": [*(f"syn_{k}_sent_len" for k in ("mean", "std", "max", "min")), "syn_n_sents"],
    "sentiment_affect": [*(f"sent_{k}_compound" for k in ("mean", "std", "min", "max", "range")), "sent_pct_positive", "sent_pct_negative"],
    "sentence_cohesion": ["coh_local_similarity", "coh_global_similarity", "sd_mean_consecutive", "sd_max_consecutive"],
    "discourse_connectives": ["coh_connective_density"],
    "stylometric_features": ["sty_function_word_ratio", "sty_punct_ratio", "sty_mean_word_length", "sty_exclamation_per_sent", "sty_question_per_sent"],
    "readability": [f"read_{k}" for k in ("flesch_ease", "flesch_kincaid", "gunning_fog", "coleman_liau", "ari", "syllables_per_word")],
    "emotional_dynamics": [f"emo_{k}" for k in ("granularity", "volatility", "word_density", "distinct_emotions")],
    "moral_reflective": [*(f"moral_{k}" for k in L.MORAL), "reflective_markers", "causal_markers", "growth_markers"],
    "authenticity_voice": [f"voice_{k}" for k in ("first_person_density", "disfluency", "contraction_density", "specific_number_density")],
    "conflict_blame": ["conflict_verb_density", "conflict_blame_density", "conflict_second_person"],
    "temporal_markers": ["narr_temporal_marker_density"],
}
#: Further tables, of the stylometric feature sets.
STYLOMETRIC = {
    "mfw_profile": [f"mfw_{k}" for k in ("top10_coverage", "top50_coverage", "concentration", "fw_ratio")],
    "delta_features": [f"delta_fw_{k}" for k in ("zscore_mean", "zscore_std", "deviation")],
    "vocab_richness": [f"vocab_{k}" for k in ("yules_k", "simpsons_d", "honores_r", "sichels_s", "brunets_w")],
    "char_ngrams": [f"char_{n}gram_{k}" for n in (2, 3, 4) for k in ("entropy", "hapax_ratio")],
    "word_length_dist": ["wlen_mean", "wlen_std", "wlen_skew", *(f"wlen_{k}" for k in range(1, 6))],
    "sent_length_dist": [f"slen_{k}" for k in ("mean", "std", "variation_coef", "short_ratio", "long_ratio")],
    "punct_patterns": [f"punct_{k}_ratio" for k in ("comma", "dash", "semicolon", "colon", "exclamation", "question")],
}
# The stylometric feature sets by name.
FULL_SET = [c for cols in STYLOMETRIC.values() for c in cols]
CORE_SET = [*(f"char_{n}gram_{k}" for k in ("entropy", "hapax_ratio") for n in (2, 3, 4)), "wlen_mean", "wlen_std", "slen_mean", "slen_std", "punct_comma_ratio", "punct_dash_ratio"]
# The refined markers with their category, citation and kind of effect.
REFINED = {
    "mfw_top50_coverage": ("Function Words", "Burrows 2002; Eder et al. 2016", "stylometric"),
    "mfw_fw_ratio": ("Function Words", "Burrows 2002; Eder et al. 2016", "stylometric"),
    "vocab_honores_r": ("Vocabulary", "Honoré 1979", "stylometric"),
    "ld_mtld": ("Vocabulary", "McCarthy & Jarvis 2010", "comparison"),
    "wlen_mean": ("Vocabulary", "Mendenhall 1887", "stylometric"),
    "char_3gram_entropy": ("Vocabulary", "Stamatatos 2009, 2013", "stylometric"),
    "vocab_yules_k": ("Vocabulary", "Yule 1944; Tweedie & Baayen 1998", "stylometric"),
    "slen_mean": ("Syntax & Punctuation", "Williams 1940; Stamatatos 2009", "stylometric"),
    "punct_comma_ratio": ("Syntax & Punctuation", "Stamatatos 2009; Grieve 2007", "stylometric"),
    "punct_dash_ratio": ("Syntax & Punctuation", "Stamatatos 2009", "stylometric"),
    "voice_contraction_density": ("Register", "Biber 1988; Heylighen & Dewaele 2002", "comparison"),
    "voice_first_person_density": ("Register", "Biber 1988", "comparison"),
    "emo_word_density": ("Register", "Pennebaker et al. 2015", "comparison"),
}


def wide_long(d: Duck, wanted: list[str]) -> str:
    """CTEs up to long (id, condition, model, marker, o, w) of any markers of the registered tables.

    Both sides of all pairs are one table of stories (2 * id and 2 * id + 1), so a
    marker table runs once over all of them; a side that is null or blank has no
    values, and a missing side drops the pair.
    """
    tables = {k: [c for c in cols if c in wanted] for k, cols in (TABLES | STYLOMETRIC).items()}
    tables = {k: cols for k, cols in tables.items() if cols}
    sides = f"stories AS (SELECT {d.near('id')} id, CAST(NULL AS STRING) AS source, CAST(NULL AS STRING) AS lang, story FROM sides WHERE trim(story) <> '')"
    subs = ",\n".join(f"t_{k} AS ({texts.QUERIES[k](d).replace(texts.stories(d), sides)})" for k in tables)
    values = " UNION ALL ".join(f"SELECT id, {d.unpivot(cols)} FROM t_{k}" for k, cols in tables.items())
    pair = "CAST(floor(id / 2.0) AS BIGINT)"
    dealt = f" dealt AS (SELECT {d.near('pair')} * FROM (SELECT *, {pair} AS pair FROM vals) AS v)," if d.spark else ""
    pair = "pair" if d.spark else pair
    return f"""{pairs(d)}, sides AS (SELECT 2 * id AS id, orig AS story FROM pairs UNION ALL SELECT 2 * id + 1 AS id, rewrite AS story FROM pairs),
    {subs}, vals AS ({values}),{dealt}
    both_sides AS (SELECT {pair} AS id, marker, max(CASE WHEN id % 2 = 0 THEN round(value, 9) END) AS o, max(CASE WHEN id % 2 <> 0 THEN round(value, 9) END) AS w FROM {'dealt' if d.spark else 'vals'} GROUP BY {pair}, marker),
    long AS (SELECT b.id, condition, model, marker, o, w FROM both_sides b JOIN pairs p ON b.id = p.id WHERE o IS NOT NULL AND w IS NOT NULL)"""


def ranks(by: str) -> str:
    """CTEs nz and rk: the sums of the signed ranks of each (group, marker), and its ties."""
    return f"""nz AS (SELECT {by}, marker, df, rank() OVER (PARTITION BY {by}, marker ORDER BY abs(df)) AS rk, count(*) OVER (PARTITION BY {by}, marker, abs(df)) AS t FROM diffs WHERE df <> 0),
    rk AS (SELECT {by}, marker, CAST(count(*) AS DOUBLE) AS m, sum(CASE WHEN df > 0 THEN rk + (t - 1) / 2.0 ELSE 0 END) AS wp, sum(CASE WHEN df < 0 THEN rk + (t - 1) / 2.0 ELSE 0 END) AS wm, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM nz GROUP BY {by}, marker)"""


def banded_ranks(d: Spark, by: str) -> str:
    """The same sums from ranks within bands of the difference, so that no task sorts all differences of a marker.

    A band's ranks begin after those of the bands below it; the bands of all markers are few.
    """
    mean = "(rk + (t - 1) / CAST(2 AS DOUBLE))"
    return f"""banded AS (SELECT {d.near(f'{by}, marker, band')} * FROM (SELECT {by}, marker, df, abs(df) AS a, floor(nanvl(16 * ln(abs(df)), CAST('Infinity' AS DOUBLE))) AS band FROM diffs WHERE df <> 0) AS b),
    nz AS (SELECT {by}, marker, band, df, rank() OVER (PARTITION BY {by}, marker, band ORDER BY a) AS rk, count(*) OVER (PARTITION BY {by}, marker, band, a) AS t FROM banded),
    bands AS (SELECT {by}, marker, band, count(*) AS m, count_if(df > 0) AS np, count_if(df < 0) AS nm, sum(CASE WHEN df > 0 THEN {mean} ELSE 0 END) AS wp, sum(CASE WHEN df < 0 THEN {mean} ELSE 0 END) AS wm, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM nz GROUP BY {by}, marker, band),
    below AS (SELECT *, CAST(sum(m) OVER (PARTITION BY {by}, marker ORDER BY band) - m AS DOUBLE) AS lower_ranks FROM bands),
    rk AS (SELECT {by}, marker, CAST(sum(m) AS DOUBLE) AS m, sum(wp + lower_ranks * np) AS wp, sum(wm + lower_ranks * nm) AS wm, sum(ties) AS ties FROM below GROUP BY {by}, marker)"""


def comparison(d: Duck, by: str = "condition, model", source: str | None = None) -> str:
    """CTEs up to comparison: the paired row of each (group, marker) with at least 10 pairs, Wilcoxon and Benjamini-Hochberg.

    source: the CTEs up to ``long``; those of the COMPARED markers where not given.
    """
    on = " AND ".join(f"st.{c.strip()} = rk.{c.strip()}" for c in (by + ", marker").split(","))
    p = f"least(CAST(1 AS DOUBLE), 2 * {upper_tail('abs(z)')})"
    cols = ", ".join("st." + c.strip() for c in by.split(","))
    return f"""{source or long(d)},
    diffs AS (SELECT {by}, marker, id, o, w, round(o - w, 9) AS df FROM long),
    st AS (SELECT {by}, marker, count(*) AS n, avg(o) AS mo, avg(w) AS mw, avg(df) AS md, stddev_samp(df) AS sd FROM diffs GROUP BY {by}, marker HAVING count(*) >= 10),
    {banded_ranks(d, by) if d.spark else ranks(by)},
    tested AS (SELECT {cols}, st.marker, n, mo, mw, md, sd, coalesce(m, 0) AS m, CAST(coalesce(least(wp, wm), 0) AS DOUBLE) AS stat,
        CASE WHEN m IS NULL THEN CAST(0 AS DOUBLE) ELSE (CAST(least(wp, wm) AS DOUBLE) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) END AS z FROM st LEFT JOIN rk ON {on}),
    pv AS (SELECT *, {p} AS p, coalesce(md / nullif(sd, 0), 0) AS cohens_d FROM tested),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p DESC, marker DESC) AS back, count(*) OVER (PARTITION BY {by}) AS family FROM pv),
    comparison AS (SELECT *, least(CAST(1 AS DOUBLE), min(p * family / (family - back + 1)) OVER (PARTITION BY {by} ORDER BY back ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q,
        CASE WHEN md > 0 THEN 'decrease' WHEN md < 0 THEN 'increase' ELSE 'none' END AS direction,
        CASE WHEN mo = 0 THEN 0 ELSE (mw - mo) / abs(mo) * 100 END AS pct FROM ranked)"""


def comparison_rows(d, source: str | None = None) -> str:
    return f"""WITH {comparison(d, source=source)} SELECT condition, model, marker, n, {r('mo', 4)} AS mean_orig, {r('mw', 4)} AS mean_rewrite, {r('md', 4)} AS mean_diff, {r('pct', 2)} AS pct_change, {r('stat', 2)} AS wilcoxon_stat, {r('z')} AS z,
    {r('p', 8)} AS p_value, p < 0.05 AS significant, {r('cohens_d', 4)} AS cohens_d, direction, {r('q', 8)} AS p_value_fdr, q < 0.05 AS significant_fdr FROM comparison"""


def compare_markers(d):
    return comparison_rows(d)


ALL_COMPARED = [c for cols in TABLES.values() for c in cols]


def compare_all_markers(d):
    """The paired comparison of every marker that needs no parser or embedder."""
    return comparison_rows(d, wide_long(d, ALL_COMPARED))


def marker_counts_by_dimension(d):
    """Markers of each dimension that the whole comparison has, against the number that it should have."""
    expected = " UNION ALL ".join(f"SELECT '{c}' AS marker" for c in ALL_COMPARED)
    return f"""WITH {comparison(d, 'condition', wide_long(d, ALL_COMPARED))}, ex AS (SELECT {dimension()} AS dimension, count(*) AS expected FROM ({expected}) AS e GROUP BY {dimension()}),
    got AS (SELECT condition, {dimension()} AS dimension, count(*) AS n, count_if(q < 0.05) AS significant FROM comparison GROUP BY condition, {dimension()})
    SELECT condition, got.dimension, n, expected, n = expected AS complete, significant FROM got JOIN ex ON got.dimension = ex.dimension"""


def wilcoxon_signed_rank(d):
    return f"WITH {comparison(d, 'condition')} SELECT condition, marker, n, CAST(m AS BIGINT) AS nonzero, {r('stat', 2)} AS w, {r('z')} AS z, {r('p', 8)} AS p FROM comparison"


def bh_fdr(d):
    return f"WITH {comparison(d, 'model')} SELECT model, marker, {r('p', 8)} AS p, family AS m, {r('q', 8)} AS q, q < 0.05 AS reject FROM comparison"


def cohens_d_variants(d):
    return f"""WITH {long(d)} SELECT condition, model, marker, count(*) AS n, {r('coalesce(avg(o - w) / nullif(stddev_samp(o - w), 0), 0)')} AS d_paired,
    {r('coalesce(avg(o - w) / nullif(sqrt((var_pop(o) + var_pop(w)) / 2), 0), 0)')} AS d_stance, {r('CASE WHEN count(*) < 2 THEN 0 ELSE coalesce((avg(w) - avg(o)) / nullif(sqrt((var_samp(o) + var_samp(w)) / 2), 0), 0) END')} AS d_pooled,
    {r('coalesce(avg(w - o) / nullif(stddev_samp(w - o), 0), 0)')} AS d_temperature FROM long GROUP BY condition, model, marker HAVING count(*) >= 2"""


def dimension(col: str = "marker") -> str:
    return f"CASE split_part({col}, '_', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DIMENSIONS.items()) + " ELSE 'other' END"


def summary_by_dimension(d):
    return f"""WITH {comparison(d)}, dims AS (SELECT *, {dimension()} AS dimension FROM comparison)
    SELECT condition, model, dimension, count(*) AS n_markers, count_if(q < 0.05) AS n_significant, {r('avg(abs(cohens_d))', 4)} AS mean_abs_cohens_d, count_if(direction = 'decrease') AS markers_decreased, count_if(direction = 'increase') AS markers_increased FROM dims GROUP BY condition, model, dimension"""


def corr(a: str, b: str, wt: str = "") -> str:
    """Pearson's r from moments; null without variance."""
    return f"((avg({a} * {b}) - avg({a}) * avg({b})) / nullif(sqrt(greatest(avg({a} * {a}) - avg({a}) * avg({a}), 0)) * sqrt(greatest(avg({b} * {b}) - avg({b}) * avg({b}), 0)), 0))"


def pearson_spearman(d):
    rank = lambda c: f"(rank() OVER (PARTITION BY model, marker ORDER BY {c}) + (count(*) OVER (PARTITION BY model, marker, {c}) - 1) / 2.0)"
    return f"""WITH {long(d)}, k AS (SELECT model, marker, o, w, CAST({rank('o')} AS DOUBLE) AS ro, CAST({rank('w')} AS DOUBLE) AS rw FROM long)
    SELECT model, marker, count(*) AS n, {r(corr('o', 'w'), 5)} AS pearson, {r(corr('ro', 'rw'), 5)} AS spearman FROM k GROUP BY model, marker"""


def tier(x: str, high: float, mid: float) -> str:
    return f"CASE WHEN {x} >= {high} THEN 'High' WHEN {x} >= {mid} THEN 'Moderate' ELSE 'Low' END"


def protocol_stability(d):
    return f"""WITH {long(d)}, a AS (SELECT marker, count(*) AS n, avg(o) AS mb, avg(w) AS ms, {corr('o', 'w')} AS pr, avg(CASE WHEN abs((w - o) / nullif(o, 0)) < 0.1 THEN 1 ELSE 0 END) * 100 AS agree FROM long GROUP BY marker)
    SELECT marker, n, {r('mb', 4)} AS mean_baseline, {r('ms', 4)} AS mean_system, {r('coalesce((ms - mb) / nullif(abs(mb), 0) * 100, 0)', 4)} AS pct_diff, {r('pr', 5)} AS pearson_r, {r('agree', 4)} AS agreement_10pct, {tier('round(pr, 8)', 0.9, 0.7)} AS stability FROM a"""


def subjects(d: Duck) -> str:
    """CTE: subject (marker, story, run, x), three line items of an order as three runs of a subject."""
    return """subject AS (SELECT marker, l_orderkey AS story, l_linenumber AS run, avg(x) AS x FROM (
        SELECT 'quantity' AS marker, l_orderkey, l_linenumber, l_quantity AS x FROM lineitem WHERE l_linenumber <= 3 UNION ALL
        SELECT 'price' AS marker, l_orderkey, l_linenumber, l_extendedprice AS x FROM lineitem WHERE l_linenumber <= 3 UNION ALL
        SELECT 'discount' AS marker, l_orderkey, l_linenumber, l_discount AS x FROM lineitem WHERE l_linenumber <= 3) u GROUP BY marker, l_orderkey, l_linenumber),
    means AS (SELECT marker, story, avg(x) AS m, stddev_samp(x) AS s FROM subject GROUP BY marker, story HAVING count(*) = 3),
    grand AS (SELECT marker, avg(m) AS g, CAST(count(*) AS DOUBLE) AS n FROM means GROUP BY marker)"""


def aligned(d: Duck) -> str:
    """CTEs up to means for Spark: ``subjects`` in one scan, a row for each order, and only then one for each marker of it."""
    kinds = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    of = lambda k: f"struct('{k}' AS marker, avg({k}) AS m, stddev_samp({k}) AS s, CASE WHEN story IS NOT NULL THEN var_pop({k}) * count({k}) END AS ssw, CASE WHEN story IS NOT NULL THEN count({k}) END AS k, CASE WHEN story IS NOT NULL THEN sum({k}) END AS t, CASE WHEN story IS NOT NULL THEN sum({k} * {k}) END AS t2, " + ", ".join(f"max(CASE WHEN run = {i} AND story IS NOT NULL THEN {k} END) AS x{i}" for i in (1, 2, 3)) + ")"
    return f"""lines AS (SELECT {d.near('l_orderkey')} l_orderkey, l_linenumber, {', '.join(kinds.values())} FROM lineitem WHERE l_linenumber <= 3),
    per AS (SELECT l_orderkey AS story, l_linenumber AS run, {', '.join(f'avg({c}) AS {k}' for k, c in kinds.items())} FROM lines GROUP BY l_orderkey, l_linenumber),
    three AS (SELECT story, array({', '.join(of(k) for k in kinds)}) AS r FROM per GROUP BY story HAVING count(*) = 3), means AS (SELECT story, inline(r) FROM three)"""


def median_by_buckets(of: str) -> str:
    """CTEs up to med (marker, median) of means.m: counts of 10000 ranges find the one with the middle, only its values are ranked."""
    return f"""b AS (SELECT marker, count(*) AS n_rows, avg(m) AS mean, count(m) AS n, min(m) AS lo, max(m) AS hi FROM {of} GROUP BY marker),
    k AS (SELECT {of}.marker, m, least(9999, coalesce(floor((m - lo) / nullif(hi - lo, 0) * 10000), 0)) AS place FROM {of} JOIN b ON {of}.marker = b.marker WHERE m IS NOT NULL),
    cum AS (SELECT marker, place, c, sum(c) OVER (PARTITION BY marker ORDER BY place) AS upto FROM (SELECT marker, place, count(*) AS c FROM k GROUP BY marker, place) AS bk),
    sel AS (SELECT cum.marker, place, upto - c AS before FROM cum JOIN b ON cum.marker = b.marker WHERE upto - c < n div 2 + 1 AND upto >= (n + 1) div 2),
    vals AS (SELECT marker, m, first AS before, sum(c) OVER (PARTITION BY marker ORDER BY m) AS upto FROM (SELECT k.marker, m, count(*) AS c FROM k JOIN sel ON k.marker = sel.marker AND k.place = sel.place GROUP BY k.marker, m) AS v JOIN (SELECT marker AS mk, min(before) AS first FROM sel GROUP BY marker) AS f ON v.marker = f.mk),
    med AS (SELECT vals.marker, (min(CASE WHEN before + upto >= (n + 1) div 2 THEN m END) + min(CASE WHEN before + upto >= n div 2 + 1 THEN m END)) / 2 AS median FROM vals JOIN b ON vals.marker = b.marker GROUP BY vals.marker)"""


def reliability_icc_cv(d):
    if d.spark:
        total = "sqrt(greatest(sum(t2) / nullif(sum(k), 0) - (sum(t) / nullif(sum(k), 0)) * (sum(t) / nullif(sum(k), 0)), 0))"
        return f"""WITH {aligned(d)}, a AS (SELECT marker, CAST(count(*) AS DOUBLE) AS n, avg(m) AS g, 3 * var_pop(m) * count(m) / nullif(count(*) - 1, 0) AS msb, avg(s / nullif(abs(m), 0)) * 100 AS cv, sum(ssw) AS ssw, {total} AS sd, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM means GROUP BY marker HAVING count(story) > 0),
        icc AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (msb - ssw / (n * 2)) / nullif(msb + 2 * ssw / (n * 2), 0))) AS icc FROM a)
        SELECT marker, CAST(n AS BIGINT) AS n, {r('icc')} AS icc, {r('cv')} AS cv, {tier('icc', 0.9, 0.7)} AS reliability, {r('m1', 4)} AS mean_r1, {r('m2', 4)} AS mean_r2, {r('m3', 4)} AS mean_r3, {r('g', 4)} AS overall_mean, {r('sd', 4)} AS overall_std FROM icc"""
    return f"""WITH {subjects(d)}, ms AS (SELECT means.marker, max(n) AS n, max(g) AS g, 3 * sum((m - g) * (m - g)) / nullif(max(n) - 1, 0) AS msb, avg(s / nullif(abs(m), 0)) * 100 AS cv FROM means JOIN grand ON means.marker = grand.marker GROUP BY means.marker),
    wi AS (SELECT subject.marker, sum((x - m) * (x - m)) AS ssw, stddev_pop(x) AS sd, avg(CASE WHEN run = 1 THEN x END) AS m1, avg(CASE WHEN run = 2 THEN x END) AS m2, avg(CASE WHEN run = 3 THEN x END) AS m3 FROM subject JOIN means ON subject.marker = means.marker AND subject.story = means.story GROUP BY subject.marker),
    icc AS (SELECT ms.marker, n, g, cv, sd, m1, m2, m3, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (msb - ssw / (n * 2)) / nullif(msb + 2 * ssw / (n * 2), 0))) AS icc FROM ms JOIN wi ON ms.marker = wi.marker)
    SELECT marker, CAST(n AS BIGINT) AS n, {r('icc')} AS icc, {r('cv')} AS cv, {tier('icc', 0.9, 0.7)} AS reliability, {r('m1', 4)} AS mean_r1, {r('m2', 4)} AS mean_r2, {r('m3', 4)} AS mean_r3, {r('g', 4)} AS overall_mean, {r('sd', 4)} AS overall_std FROM icc"""


def run_alignment(d):
    if d.spark:
        return f"WITH {aligned(d)}, {median_by_buckets('means')} SELECT b.marker, n_rows AS n_aligned, {r('mean', 4)} AS mean, {r('median', 4)} AS median FROM b LEFT JOIN med ON b.marker = med.marker"
    return f"WITH {subjects(d)} SELECT marker, count(*) AS n_aligned, {r('avg(m)', 4)} AS mean, {r('median(m)', 4)} AS median FROM means GROUP BY marker"


def temperature_stability(d):
    """Effect of each marker at each temperature (the conditions stand in), and the correlation of the effects between temperatures."""
    return f"""WITH {long(d)}, eff AS (SELECT condition AS t, marker, coalesce(avg(w - o) / nullif(stddev_samp(w - o), 0), 0) AS e FROM long GROUP BY condition, marker)
    SELECT a.t AS t1, b.t AS t2, count(*) AS n, {r(corr('a.e', 'b.e'), 5)} AS pearson_r, {r('max(abs(a.e - b.e))', 5)} AS max_abs_diff FROM eff a JOIN eff b ON a.marker = b.marker AND a.t < b.t GROUP BY a.t, b.t"""


def temperature_summary(d):
    return f"""WITH {long(d)}, eff AS (SELECT model, condition AS t, marker, coalesce(avg(w - o) / nullif(stddev_samp(w - o), 0), 0) AS e FROM long GROUP BY model, condition, marker),
    pr AS (SELECT a.model, {corr('a.e', 'b.e')} AS pr FROM eff a JOIN eff b ON a.model = b.model AND a.marker = b.marker AND a.t < b.t GROUP BY a.model, a.t, b.t HAVING count(*) > 2)
    SELECT model, {r('avg(pr)', 5)} AS mean_r, {r('min(pr)', 5)} AS min_r, {tier('round(avg(pr), 8)', 0.85, 0.7)} AS stability FROM pr GROUP BY model"""


def direction_agreement(d):
    return f"""WITH {comparison(d)}, g AS (SELECT condition, marker, count(*) AS n, count(DISTINCT sign(round(cohens_d, 8))) AS signs FROM comparison GROUP BY condition, marker)
    SELECT condition, count_if(n = 3) AS markers, count_if(n = 3 AND signs = 1) AS agreeing FROM g GROUP BY condition"""


def condition_vs_generic(d):
    """For each condition and model: share of markers whose direction equals the same model's generic condition."""
    return f"""WITH {comparison(d)}, j AS (SELECT a.condition, a.model, a.marker, a.cohens_d AS x, b.cohens_d AS y FROM comparison a JOIN comparison b ON a.model = b.model AND a.marker = b.marker AND b.condition = 'generic' WHERE a.condition <> 'generic')
    SELECT condition, model, count(*) AS n, {r('avg(CASE WHEN (round(x, 8) > 0) = (round(y, 8) > 0) THEN 1 ELSE 0 END)')} AS agreement FROM j GROUP BY condition, model"""


def refined(d: Duck) -> str:
    """CTEs up to refined: the REFINED markers, pooled d towards the rewrite for stylometric ones, the paired comparison's d for the others."""
    case = lambda k: "CASE marker " + " ".join(f"WHEN '{m}' THEN {d.s(v[k])}" for m, v in REFINED.items()) + " END"
    pooled = "(avg(w) - avg(o)) / nullif(sqrt((var_samp(o) + var_samp(w)) / 2), 0)"
    return f"""{comparison(d, source=wide_long(d, list(REFINED)))}, pooled AS (SELECT condition, model, marker, {pooled} AS dp FROM long GROUP BY condition, model, marker),
    refined AS (SELECT c.condition, c.model, c.marker, {case(0).replace('marker', 'c.marker', 1)} AS category, {case(1).replace('marker', 'c.marker', 1)} AS citation, mo, mw, p, pct,
        CASE WHEN {case(2).replace('marker', 'c.marker', 1)} = 'stylometric' THEN coalesce(dp, 0) ELSE -cohens_d END AS d FROM comparison c JOIN pooled ON c.condition = pooled.condition AND c.model = pooled.model AND c.marker = pooled.marker)"""


def refined_effects(d):
    return f"WITH {refined(d)} SELECT condition, model, marker, category, citation, {r('mo')} AS orig_mean, {r('mw')} AS rewrite_mean, {r('d')} AS cohens_d, {r('p', 8)} AS p_value, {r('pct', 4)} AS pct_change FROM refined"


def refined_categories(d):
    """Mean size of the refined effects by condition and category, over all models."""
    return f"WITH {refined(d)} SELECT condition, category, count(DISTINCT marker) AS n_markers, {r('avg(abs(d))')} AS mean_abs_d FROM refined GROUP BY condition, category"


def category_summary(d):
    return f"WITH {comparison(d)} SELECT {dimension()} AS category, count(*) AS n, {r('avg(abs(cohens_d))')} AS mean_abs_d FROM comparison GROUP BY {dimension()}"


def table_significance(d):
    return f"WITH {comparison(d)} SELECT model, count_if(q < 0.05) AS significant, count(*) AS total, {r('avg(abs(cohens_d))', 4)} AS mean_abs_d FROM comparison WHERE condition = 'generic' GROUP BY model"


def table_conditions(d):
    return f"WITH {comparison(d)} SELECT condition, {r('avg(CASE WHEN q < 0.05 THEN 1 ELSE 0 END) * 100', 4)} AS pct_significant, {r('avg(abs(cohens_d))', 4)} AS mean_abs_d FROM comparison GROUP BY condition"


def table_dimensions(d):
    cols = ", ".join(f"{r(f'avg(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN -cohens_d END)', 4)} AS d_{m}, count_if(model = '{m}' AND q < 0.05) AS sig_{m}" for m in MODELS)
    return f"WITH {comparison(d)} SELECT {dimension()} AS dimension, {cols}, CASE WHEN round(avg(-cohens_d), 8) > 0.1 THEN 'up' WHEN round(avg(-cohens_d), 8) < -0.1 THEN 'down' ELSE 'flat' END AS arrow FROM comparison GROUP BY {dimension()}"


def table_models(d):
    cols = ", ".join(f"{r(f'd_{c}', 4)} AS d_{c}" for c in CONDITIONS)
    by_model = ", ".join(f"avg(CASE WHEN condition = '{c}' THEN abs(cohens_d) END) AS d_{c}" for c in CONDITIONS)
    mean = ", ".join(f"avg(d_{c}) AS d_{c}" for c in CONDITIONS)
    return f"""WITH {comparison(d)}, m AS (SELECT model, {by_model} FROM comparison GROUP BY model), every_row AS (SELECT model, {', '.join(f'd_{c}' for c in CONDITIONS)} FROM m UNION ALL SELECT 'mean' AS model, {mean} FROM m)
    SELECT model, {cols}, {r('(1 - d_voice_preserving / nullif(d_generic, 0)) * 100', 4)} AS reduction_pct FROM every_row"""


def table_key_markers(d):
    cols = ", ".join(f"{r(f'avg(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN pct END)', 4)} AS pct_{m}" for m in MODELS)
    return f"WITH {comparison(d)} SELECT marker, {cols} FROM comparison WHERE condition = 'generic' AND marker IN ('ld_ttr', 'slen_mean', 'read_ari', 'punct_comma_ratio') GROUP BY marker"


def marker_count_validation(d):
    return f"WITH {comparison(d)} SELECT condition, model, count(*) AS n, count(*) = {len(COMPARED)} AS complete FROM comparison GROUP BY condition, model"


def pivot_effects(d):
    cols = ", ".join(f"{r(f'avg(CASE WHEN condition = {chr(39)}{c}{chr(39)} THEN cohens_d END)', 4)} AS {c}" for c in CONDITIONS)
    return f"WITH {comparison(d)} SELECT marker, {cols}, {r('avg(cohens_d)', 4)} AS mean FROM comparison GROUP BY marker"


def topk_cross_model(d):
    return f"WITH {comparison(d)}, a AS (SELECT marker, round(avg(abs(cohens_d)), 6) AS m, count(*) AS n FROM comparison GROUP BY marker) SELECT marker, {r('m')} AS mean_abs_d, n FROM a ORDER BY m DESC, marker LIMIT 10"


def highlights(d):
    return f"WITH {comparison(d)}, k AS (SELECT *, row_number() OVER (PARTITION BY condition, model ORDER BY round(p, 10), marker) AS pos FROM comparison WHERE q < 0.05) SELECT condition, model, pos, marker, direction, {r('cohens_d', 4)} AS cohens_d, {r('pct', 2)} AS pct_change FROM k WHERE pos <= 10"


def radar_effects(d):
    cols = ", ".join(f"{r(f'avg(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN -cohens_d END)', 4)} AS {m}" for m in MODELS)
    return f"WITH {comparison(d)} SELECT condition, marker, {cols}, {r('avg(-cohens_d)', 4)} AS mean FROM comparison GROUP BY condition, marker"


def paired_histogram(d):
    """30 equal bins over both sides together, as densities."""
    return f"""WITH {long(d)}, v AS (SELECT marker, 'original' AS side, o AS x FROM long UNION ALL SELECT marker, 'rewrite' AS side, w AS x FROM long), e AS (SELECT marker, min(x) AS a, max(x) AS b, count(*) / 2.0 AS n FROM v GROUP BY marker HAVING max(x) > min(x)),
    b AS (SELECT v.marker, side, CAST(least(29, floor((x - a) / (b - a) * 30)) AS BIGINT) AS bin, n, b - a AS wide FROM v JOIN e ON v.marker = e.marker)
    SELECT marker, side, bin, count(*) AS n, {r('count(*) / max(n) / (max(wide) / 30)', 5)} AS density FROM b GROUP BY marker, side, bin"""


def kde_density(d):
    """Gaussian kernel density at 200 points of the originals' mean word length, Scott's bandwidth."""
    grid = d.seq(0, 199)
    return f"""WITH {long(d)}, x AS (SELECT o FROM long WHERE marker = 'sty_mean_word_length'), s AS (SELECT min(o) AS a, max(o) AS b, stddev_samp(o) * power(count(*), -0.2) AS h FROM x), g AS (SELECT a, b, h, {d.explode(grid)} AS k FROM s),
    pts AS (SELECT k, h, a + (b - a) * k / 199.0 AS t FROM g) SELECT CAST(k AS BIGINT) AS k, {r('max(t)')} AS t, {r('avg(exp(-0.5 * ((t - o) / h) * ((t - o) / h)) / (h * 2.5066282746310002))')} AS density FROM pts CROSS JOIN x GROUP BY k"""


def transformation(d):
    """Length ratios, vocabulary overlap and normalised edit distance by character of each pair."""
    ow, rw = (d.tokens(x, r"[^ \t\n\r]+") for x in ("lower(orig)", "lower(rewrite)"))
    return f"""WITH {pairs(d)}, t AS (SELECT {d.near('id')} id, orig, rewrite, {d.distinct(ow)} AS a, {d.distinct(rw)} AS b, CAST({d.size(ow)} AS DOUBLE) AS na, CAST({d.size(rw)} AS DOUBLE) AS nb FROM pairs WHERE orig IS NOT NULL AND rewrite IS NOT NULL),
    u AS (SELECT *, CAST({d.size(d.both('a', 'b'))} AS DOUBLE) AS both_ FROM t)
    SELECT id, {r('coalesce(length(rewrite) / nullif(CAST(length(orig) AS DOUBLE), 0), 1)')} AS trans_length_ratio, {r('coalesce(nb / nullif(na, 0), 1)')} AS trans_word_ratio,
    {r(f"coalesce(both_ / nullif({d.size('a')} + {d.size('b')} - both_, 0), 1)")} AS trans_vocab_jaccard,
    {r(f"coalesce({d.levenshtein('orig', 'rewrite')} / nullif(CAST(greatest(length(orig), length(rewrite)) AS DOUBLE), 0), 0)")} AS trans_char_edit_distance FROM u"""


def transformation_bars(d):
    return f"""WITH {pairs(d)}, t AS (SELECT model, length(rewrite) / nullif(CAST(length(orig) AS DOUBLE), 0) AS x FROM pairs) SELECT model, count(x) AS n, {r('avg(x)')} AS mean, {r('stddev_samp(x) / sqrt(count(x))')} AS sem FROM t GROUP BY model"""


def stylometric_delta(d):
    return f"WITH {long(d)} SELECT id, count(*) AS n_markers, {r('avg(abs(w - o))', 5)} AS mean_abs_delta, {r('max(abs(w - o))', 5)} AS max_abs_delta FROM long GROUP BY id"


def stylometric_deltas(d):
    """Rewrite less original of each stylometric marker, and the mean and largest size of these differences."""
    cols = ", ".join(f"{r(f'max(CASE WHEN marker = {chr(39)}{c}{chr(39)} THEN w - o END)')} AS {c}_delta" for c in FULL_SET)
    return f"WITH {wide_long(d, FULL_SET)} SELECT id, {cols}, {r('avg(abs(w - o))', 4)} AS mean_abs_delta, {r('max(abs(w - o))')} AS max_abs_delta FROM long GROUP BY id"


def convergence(d):
    """Mean pairwise Delta of the originals, of all rewrites and of each model's, each scaled apart, for both feature sets.

    The mean comes from sorted prefix sums of each marker, without pairs; the
    ratio is that of the originals to the group.
    """
    sets = f"SELECT 'full' AS feature_set, grp, id, marker, x FROM g UNION ALL SELECT 'core' AS feature_set, grp, id, marker, x FROM g WHERE marker IN {words_in(CORE_SET)}"
    return f"""WITH {wide_long(d, FULL_SET)}, g AS (SELECT 'originals' AS grp, id, marker, o AS x FROM long UNION ALL SELECT 'rewrites' AS grp, id, marker, w AS x FROM long UNION ALL SELECT model AS grp, id, marker, w AS x FROM long), s AS ({sets}),
    sc AS (SELECT feature_set, grp, marker, avg(x) AS mu, coalesce(nullif(stddev_pop(x), 0), 1) AS sd, count(*) AS n FROM s GROUP BY feature_set, grp, marker),
    z AS (SELECT s.feature_set, s.grp, s.marker, n, (x - mu) / sd AS v, row_number() OVER (PARTITION BY s.feature_set, s.grp, s.marker ORDER BY x, id) AS i FROM s JOIN sc ON s.feature_set = sc.feature_set AND s.grp = sc.grp AND s.marker = sc.marker),
    m AS (SELECT feature_set, grp, max(n) AS n, count(DISTINCT marker) AS n_features, sum((2.0 * i - n - 1) * v) / nullif(max(n) * (max(n) - 1) / 2.0, 0) / count(DISTINCT marker) AS delta FROM z GROUP BY feature_set, grp)
    SELECT m.feature_set, m.grp, m.n, m.n_features, {r('m.delta', 5)} AS mean_delta, {r('o.delta / nullif(m.delta, 0)', 5)} AS convergence_ratio FROM m JOIN m o ON m.feature_set = o.feature_set AND o.grp = 'originals'"""


def reliability_summary(d):
    """Medians of the reliability table, its tiers and the share of highly reliable markers."""
    return f"""WITH t AS (SELECT * FROM ({reliability_icc_cv(d)}) AS r) SELECT count(*) AS n_markers, {r('median(icc)', 5)} AS median_icc, {r('median(cv)', 5)} AS median_cv, count_if(reliability = 'High') AS high, count_if(reliability = 'Moderate') AS moderate, count_if(reliability = 'Low') AS low,
    {r('avg(CASE WHEN icc >= 0.9 THEN 1 ELSE 0 END) * 100', 4)} AS pct_high FROM t"""


def temperature_extremes(d):
    """The five markers whose effect changes most, and least, between the first and the last temperature, by model."""
    first, last = sorted(CONDITIONS)[0], sorted(CONDITIONS)[-1]
    return f"""WITH {long(d)}, eff AS (SELECT model, condition AS t, marker, coalesce(avg(w - o) / nullif(stddev_samp(w - o), 0), 0) AS e FROM long GROUP BY model, condition, marker),
    df AS (SELECT a.model, a.marker, round(a.e, 8) AS e1, round(b.e, 8) AS e2, round(abs(a.e - b.e), 8) AS diff FROM eff a JOIN eff b ON a.model = b.model AND a.marker = b.marker AND a.t = '{first}' AND b.t = '{last}'),
    k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY diff DESC, marker) AS top, row_number() OVER (PARTITION BY model ORDER BY diff, marker DESC) AS low FROM df)
    SELECT model, marker, {r('e1', 5)} AS d_first, {r('e2', 5)} AS d_last, {r('diff', 5)} AS diff, CASE WHEN top <= 5 THEN 'sensitive' ELSE 'stable' END AS kind FROM k WHERE top <= 5 OR low <= 5"""


def vectors(d: Duck) -> str:
    return "vecs AS (SELECT vec_id AS id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL)"


def semantic_cosine(d):
    """Cosine of consecutive vectors of a label; null where a norm is zero."""
    return f"""WITH {vectors(d)}, p AS (SELECT id, label, e, lead(e) OVER (PARTITION BY label ORDER BY id) AS f, lead(id) OVER (PARTITION BY label ORDER BY id) AS next_id FROM vecs)
    SELECT id, next_id, {r(f"{d.dot('e', 'f')} / nullif(sqrt({d.dot('e', 'e')}) * sqrt({d.dot('f', 'f')}), 0)", 5)} AS cosine FROM p WHERE f IS NOT NULL"""


def exploded(d: Duck) -> str:
    if d.spark:
        return f"{vectors(d)}, cells AS (SELECT id, label, k, CAST(x AS DOUBLE) AS x FROM vecs LATERAL VIEW posexplode(e) pe AS k, x)"
    return f"{vectors(d)}, cells AS (SELECT id, label, unnest(range(0, len(e))) AS k, CAST(unnest(e) AS DOUBLE) AS x FROM vecs)"


def burrows_delta_mean(d):
    """Mean pairwise Delta of each label from sorted prefix sums: no pair is ever formed."""
    return f"""WITH {exploded(d)}, z AS (SELECT label, k, avg(x) AS mu, coalesce(nullif(stddev_pop(x), 0), 1) AS sd, count(*) AS n FROM cells GROUP BY label, k),
    o AS (SELECT cells.label, cells.k, (x - mu) / sd AS v, n, row_number() OVER (PARTITION BY cells.label, cells.k ORDER BY x, id) AS i FROM cells JOIN z ON cells.label = z.label AND cells.k = z.k)
    SELECT label, max(n) AS n, {r('sum((2.0 * i - n - 1) * v) / nullif(max(n) * (max(n) - 1) / 2.0, 0) / count(DISTINCT k)', 5)} AS mean_delta FROM o GROUP BY label"""


def convergence_spread(d):
    """Spread of each label around its centroid, raw and as a ratio to all vectors'."""
    return f"""WITH {exploded(d)}, m AS (SELECT label, k, avg(x) AS mu FROM cells GROUP BY label, k), q AS (SELECT cells.label, id, sqrt(sum((x - mu) * (x - mu))) AS dist FROM cells JOIN m ON cells.label = m.label AND cells.k = m.k GROUP BY cells.label, id)
    SELECT label, count(*) AS n, {r('avg(dist)', 5)} AS mean_distance, {r('stddev_pop(dist)', 5)} AS std_distance, {r('min(dist)', 5)} AS min_distance, {r('max(dist)', 5)} AS max_distance FROM q GROUP BY label"""


def standardised(d: Duck, fit: str) -> str:
    """CTEs up to zl (id, model, marker, zo, zw): z scores by the originals of each model, by its rewrites, or by both sides stacked."""
    side = {"reference": "o", "rewrites": "w", "stacked": "o"}[fit]
    both = f"SELECT model, marker, {side} AS x FROM long" + (" UNION ALL SELECT model, marker, w AS x FROM long" if fit == "stacked" else "")
    return f"""{long(d)}, fit AS ({both}), sc AS (SELECT model, marker, avg(x) AS mu, coalesce(nullif(stddev_pop(x), 0), 1) AS sd FROM fit GROUP BY model, marker),
    zl AS (SELECT id, long.model, long.marker, (o - mu) / sd AS zo, (w - mu) / sd AS zw FROM long JOIN sc ON long.model = sc.model AND long.marker = sc.marker)"""


def side_by_side(d: Duck, fit: str, sides: dict[str, str]) -> str:
    """CTEs up to wide: one row per text, a column for each side and COMPARED marker, so that a pair's distance is one expression."""
    cols = ", ".join(f"max(CASE WHEN marker = '{c}' THEN {v} END) AS {s}_{c}" for s, v in sides.items() for c in COMPARED)
    return f"{standardised(d, fit)}, wide AS (SELECT model, id, {cols} FROM zl GROUP BY model, id)"


def distance(x: str, y: str) -> str:
    """Mean absolute difference over the markers that both have."""
    diffs = [f"abs({x}_{c} - {y}_{c})" for c in COMPARED]
    return "((" + " + ".join(f"coalesce({e}, 0)" for e in diffs) + ") / (" + " + ".join(f"CASE WHEN {e} IS NULL THEN 0.0 ELSE 1.0 END" for e in diffs) + "))"


def source_matching(d, fit="reference"):
    """Nearest rewrite of each original within a model's texts by mean absolute z difference, and the share that hit their own."""
    best = d.best(f"round({distance('a.o', 'b.w')}, 8)", "b.id")
    return f"""WITH {side_by_side(d, fit, {'o': 'zo', 'w': 'zw'})}, best AS (SELECT a.model, a.id AS original, {best} AS rewrite FROM wide a JOIN wide b ON a.model = b.model GROUP BY a.model, a.id)
    SELECT model, count(*) AS n, {r('100.0 * count_if(original = rewrite) / count(*)', 4)} AS accuracy, {r('100.0 / count(*)', 4)} AS chance FROM best GROUP BY model"""


def source_matching_stacked(d):
    return source_matching(d, "stacked")


def stance_effects(d):
    """The stance kind of Cohen's d for the markers that the stance figure shows, by condition."""
    shown = words_in(["slen_mean", "punct_comma_ratio", "sty_mean_word_length", "wlen_long_ratio", "ld_ttr"])
    return f"""WITH {long(d)} SELECT condition, marker, count(*) AS n, {r('coalesce(avg(o - w) / nullif(sqrt((var_pop(o) + var_pop(w)) / 2), 0), 0)')} AS d_stance FROM long WHERE marker IN {shown} GROUP BY condition, marker"""


def burrows_delta_pairs(d):
    """Min, max, mean and deviation of pairwise Delta among the rewrites of each model."""
    return f"""WITH {side_by_side(d, 'rewrites', {'w': 'zw'})}, p AS (SELECT a.model, {distance('a.w', 'b.w')} AS dd FROM wide a JOIN wide b ON a.model = b.model AND a.id < b.id)
    SELECT model, count(*) AS n_pairs, {r('avg(dd)', 5)} AS mean, {r('stddev_pop(dd)', 5)} AS std, {r('min(dd)', 5)} AS min, {r('max(dd)', 5)} AS max FROM p GROUP BY model"""


QUERIES = {
    f.__name__: f
    for f in (
        compare_markers, compare_all_markers, marker_counts_by_dimension, refined_categories, stylometric_deltas, convergence, reliability_summary, temperature_extremes, wilcoxon_signed_rank, bh_fdr, cohens_d_variants, summary_by_dimension, pearson_spearman, protocol_stability, reliability_icc_cv, run_alignment, temperature_stability, temperature_summary, direction_agreement, condition_vs_generic, refined_effects, category_summary, table_significance, table_conditions, table_dimensions,
        table_models, table_key_markers, marker_count_validation, pivot_effects, topk_cross_model, highlights, radar_effects, paired_histogram, kde_density, transformation, transformation_bars, stylometric_delta, semantic_cosine, burrows_delta_mean, convergence_spread, source_matching, source_matching_stacked, stance_effects, burrows_delta_pairs,
    )
}
