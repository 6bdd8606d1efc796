"""Every query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from inkvane.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(pdf):
    def one(v):
        if v is None or v != v:
            return None
        return round(v, 5) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(one(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert catalog.entry(spark, "/root/testdata/sf0.001").count() > 0


ODD = [(1, "a b a"), (1, "b a. c"), (2, "...!"), (2, "one two one"), (3, "日本語の 文字 文字。日本"), (4, "😀a😀a 😀a"), (5, "abc"), (6, "Istanbul straße ÉTÉ été"), (7, " ".join(chr(0x4E00 + k % 3000) + chr(0x61 + k % 26) for k in range(4000)))]
#: Queries that count within a row: no row for each word or gram is made, so none is shuffled, sorted or spilled.
WITHIN = ["char_ngrams", "lexical_diversity", "textual_entropy", "mfw_profile", "mfw_frequencies", "vocab_richness", "word_length_dist", "mtld"]


@pytest.mark.parametrize("name", WITHIN)
def test_counts_within_a_row(spark, name, monkeypatch):
    from inkvane.functions import counted
    from inkvane.operators.markers import marker_table
    from inkvane.plans import texts
    from inkvane.plans.dialect import Duck

    odd = [x for x in ODD if x[0] > 2] if name == "mtld" else ODD  # texts that share an id have no order there
    given = ", ".join(f"({k}, 'x', 'x', '{t}')" for k, t in odd)
    want = duckdb.sql(texts.QUERIES[name](Duck()).replace(texts.stories(Duck()), f"stories AS (SELECT * FROM (VALUES {given}) AS v(id, source, lang, story))")).df()
    monkeypatch.setattr(counted, "UNITS", 5)
    got = marker_table(spark.createDataFrame(odd, "id long, story string").coalesce(1), name)
    assert rows(got.toPandas()) == rows(want)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString() and "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["source_matching", "source_matching_stacked", "burrows_delta_pairs"])
def test_pairs_in_small_blocks(spark, duck, sf, name, monkeypatch):
    """Every pair of texts meets once, however small the blocks; no join makes a row for each pair."""
    from inkvane.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 5)
    got = catalog.queries()[name](spark, sf)
    assert rows(got.toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_distance_over_common_columns():
    import numpy as np

    from inkvane.operators.matching import distances

    a, b = np.array([[1.0, np.nan, 3.0]]), np.array([[2.0, 5.0, 3.0], [1.0, 1.0, np.nan]])
    assert distances(a, b).tolist() == [[0.5, 0.0]]


@pytest.mark.parametrize("name", ["convergence", "refined_effects", "compare_all_markers"])
def test_markers_of_pairs_are_computed_once(spark, sf, name):
    assert "regexp" not in catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_sides_compare_like_tables(spark):
    from inkvane.operators import markers

    words = "I think maybe we walked home and laughed because it was late".split()
    data = [(k, " ".join(words[: 3 + k % 9]) + ". " + " ".join(words[k % 5 :]) + "!", None if k == 3 else " ".join(words[k % 7 :]) + ".") for k in range(14)]
    pairs = spark.createDataFrame(data, "id long, orig string, rewrite string")
    sides = [markers.compute_all_markers(pairs.select("id", F.col(c).alias("story")), include_empathic=True) for c in ("orig", "rewrite")]
    got = markers.compare_sides(pairs)
    assert rows(got.toPandas()) == rows(markers.compare_tables(*sides).toPandas())
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_median_of_runs_on_odd_orders(spark, tmp_path):
    """Null and equal values, orders of fewer or more runs, doubled lines; the exact median without all values in one group."""
    lines = [(o, n, None if (o, n) == (4, 2) else float(o * o % 11), float(o * 7.5 + n), 0.1) for o in range(40) for n in range(1, 3 + o % 3)] + [(1, 1, 5.0, 2.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("run_alignment", "reliability_icc_cv"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = duckdb.sql(catalog.oracle_sql()[name].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).df()
        assert rows(got.toPandas()) == rows(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "median(" not in plan and "percentile" not in plan and "Union" not in plan


@pytest.mark.parametrize("name", ["lexical_diversity", "mfw_frequencies", "vocab_richness", "char_ngrams"])
def test_texts_are_dealt_by_their_size(spark, sf, name, monkeypatch):
    """A task's share of the texts does not grow with the input, and words are grouped as texts, not as lists."""
    from inkvane.plans import dialect

    monkeypatch.setattr(dialect, "PART_BYTES", 20_000)
    got = catalog.queries()[name](spark, sf)
    assert got.rdd.getNumPartitions() > 10
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_in_bands(spark):
    """Ties, signs, zeros and differences of every size: the same sums of ranks, and no window over all of a marker's differences."""
    from inkvane.plans import statistics
    from inkvane.plans.dialect import Duck, Spark

    long = [("c", "m", f"k{k % 3}", i, float(i * 37 % 101) ** (1 + k % 3), float(i * 53 % 89) / (1 + k * 40)) for k in range(3) for i in range(60)] + [("c", "m", "k0", 99, 1e9, 0.0), ("c", "m", "k0", 100, 0.0, 1e-9)]
    spark.createDataFrame(long, "condition string, model string, marker string, id long, o double, w double").createOrReplaceTempView("given_long")
    got = spark.sql(statistics.comparison_rows(Spark(5), "long AS (SELECT * FROM given_long)"))
    values = ", ".join(f"('{c}', '{m}', '{k}', {i}, CAST({o!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for c, m, k, i, o, w in long)
    want = duckdb.sql(statistics.comparison_rows(Duck(), f"long AS (SELECT * FROM (VALUES {values}) AS v(condition, model, marker, id, o, w))")).df()
    assert rows(got.toPandas()) == rows(want)
    assert "band" in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "rank(a" in x)


COHESIVE = [(1, "One two three four. Two three four! Nine ten\nTwo three eleven nine? two three FOUR"), (1, "a b c. a b c"), (1, "alone here now"), (2, ""), (3, "...!\n\n..."), (4, "日本 語の 文字. 日本 文字 語の! x y"), (5, "one one one. two two. one two three")]


@pytest.mark.parametrize("units", [1, 1_000_000])
def test_cohesion_within_a_row(spark, monkeypatch, units):
    """Texts that share an id, repeated words, short sentences; no row for each word of a sentence, and the texts are parsed once."""
    from inkvane.functions import counted
    from inkvane.operators.markers import marker_table
    from inkvane.plans import texts
    from inkvane.plans.dialect import Duck

    given = ", ".join(f"({k}, 'x', 'x', '{t}')" for k, t in COHESIVE if t)
    want = duckdb.sql(texts.sentence_cohesion(Duck()).replace(texts.stories(Duck()), f"stories AS (SELECT * FROM (VALUES {given}) AS v(id, source, lang, story))")).df()
    monkeypatch.setattr(counted, "UNITS", units)
    got = marker_table(spark.createDataFrame(COHESIVE, "id long, story string").coalesce(1), "sentence_cohesion")
    assert rows(got.toPandas()) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "flatten" not in plan


@pytest.mark.parametrize("name", ["stance_experiential", "stance_orality"])
def test_endings_and_phrases(spark, name):
    """Overlapping phrases, phrases inside words, words that are a suffix; no pattern is matched with each word."""
    from inkvane.operators.markers import marker_table
    from inkvane.plans import texts
    from inkvane.plans.dialect import Duck

    odd = [(1, "What this meant: only then, what this means. Residue to dom nations, ure"), (2, "Looking  back. looking back! IN HINDSIGHT it took meat"), (3, "日本tion été ness"), (4, "...")]
    given = ", ".join(f"({k}, 'x', 'x', '{t}')" for k, t in odd)
    want = duckdb.sql(texts.QUERIES[name](Duck()).replace(texts.stories(Duck()), f"stories AS (SELECT * FROM (VALUES {given}) AS v(id, source, lang, story))")).df()
    got = marker_table(spark.createDataFrame(odd, "id long, story string"), name)
    assert rows(got.toPandas()) == rows(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("locate(") + plan.count("position(") == 0
