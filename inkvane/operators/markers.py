"""Marker tables of any (id, story) DataFrame: the mergers over the relational marker texts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import counted
from ..functions.annotate import semantic_markers, syntax_markers
from ..plans import statistics, texts
from ..plans.dialect import Spark
from .matching import stored, view

BASE = ["lexical_diversity", "mtld", "sentence_lengths", "textual_entropy", "sentiment_affect", "discourse_connectives", "stylometric_features", "readability"]
EMPATHIC = ["emotional_dynamics", "moral_reflective", "authenticity_voice", "conflict_blame", "temporal_markers"]
STYLOMETRIC = ["char_ngrams", "mfw_profile", "vocab_richness", "word_length_dist", "punct_patterns", "sent_length_dist", "delta_features"]
INDEXICAL = ["stance_epistemic", "stance_involvement", "stance_orality", "stance_temporal_causal", "stance_affect", "stance_experiential"]


def marker_table(stories: DataFrame, name: str) -> DataFrame:
    """One registered marker table over (id, story); texts that are null or blank have no row."""
    view = f"stories_{uuid.uuid4().hex[:12]}"
    stories.select("id", "story").createOrReplaceTempView(view)
    d = Spark()
    text = texts.QUERIES[name](d).replace(texts.stories(d), f"stories AS (SELECT {d.near('id')} id, CAST(NULL AS STRING) AS source, CAST(NULL AS STRING) AS lang, story FROM {view} WHERE trim(story) <> '')")
    counted.register(stories.sparkSession, text)
    return stories.sparkSession.sql(text)


def merged(stories: DataFrame, names: list[str]) -> DataFrame:
    """Tables side by side; every id stays, a blank text has nulls only."""
    tables = [marker_table(stories, n) for n in names]
    return reduce(lambda a, b: a.join(b, "id", "left"), tables, stories.select("id"))


#: Tags whose shares are columns of their own; a tag that a text lacks is null.
TAGS = "punct pron adv noun adj verb aux det adp cconj sconj num propn".split()


def syntax_columns(stories: DataFrame) -> DataFrame:
    """Tag-based markers with a column pos_<tag>_ratio for each tag."""
    t = syntax_markers(stories)
    return t.select("*", *(F.element_at("pos", f"pos_{k}_ratio").alias(f"pos_{k}_ratio") for k in TAGS)).drop("pos")


def compute_all_markers(stories: DataFrame, include_empathic: bool = False, include_stylometric: bool = False) -> DataFrame:
    names = BASE + (EMPATHIC if include_empathic else []) + (STYLOMETRIC if include_stylometric else [])
    extra = [syntax_columns(stories), semantic_markers(stories)]
    return reduce(lambda a, b: a.join(b, "id", "left"), extra, merged(stories, names))


def numeric_markers(orig: DataFrame, rewrite: DataFrame, excluded: tuple[str, ...] = ("id",)) -> list[str]:
    """Sorted names of the numeric columns that both tables have."""
    numeric = lambda df: {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    return sorted((numeric(orig) & numeric(rewrite)) - set(excluded))


def with_prefix(table: DataFrame, prefix: str = "idx_") -> DataFrame:
    """The id and the columns whose names begin with the prefix."""
    return table.select("id", *(c for c in table.columns if c.startswith(prefix)))


def marker_stems(columns: list[str], suffixes: list[str]) -> list[str]:
    """Sorted names that occur with every one of the suffixes, such as _r1, _r2 and _r3."""
    return sorted(set.intersection(*({c[: -len(s)] for c in columns if c.endswith(s)} for s in suffixes)))


def compare_tables(orig: DataFrame, rewrite: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """The paired comparison of two marker tables of (id, markers); all shared numeric columns where no markers are named.

    A pair counts for a marker where both sides are neither null nor NaN, a marker
    from 10 pairs on; other columns are not read.
    """
    spark, cols = orig.sparkSession, markers or numeric_markers(orig, rewrite)
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]
    long = lambda df, v: df.select("id", *clean).unpivot(["id"], cols, "marker", v)
    view = f"long_{uuid.uuid4().hex[:12]}"
    both = long(orig, "o").join(long(rewrite, "w"), ["id", "marker"]).filter("o is not null and w is not null")
    both.select("id", F.lit("all").alias("condition"), F.lit("all").alias("model"), "marker", F.round("o", 9).alias("o"), F.round("w", 9).alias("w")).createOrReplaceTempView(view)
    return spark.sql(statistics.comparison_rows(Spark(), f"long AS (SELECT * FROM {view})")).drop("condition", "model")


def compare_sides(pairs: DataFrame) -> DataFrame:
    """The paired comparison of all base and empathic markers of (id, orig, rewrite), as ``compare_tables`` has it.

    Both sides are one table of stories (2 * id and 2 * id + 1), over which each
    marker table runs once; tables meet as rows of (id, marker), not in joins.
    """
    spark = pairs.sparkSession
    sides = stored(pairs.select((F.col("id") * 2).alias("id"), F.col("orig").alias("story")).union(pairs.select(F.col("id") * 2 + 1, "rewrite")))
    rows = []
    for t in [*(marker_table(sides, n) for n in BASE + EMPATHIC), syntax_columns(sides), semantic_markers(sides)]:
        cols = numeric_markers(t, t)
        rows.append(t.select("id", *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols)).unpivot(["id"], cols, "marker", "x").filter("x is not null"))
    both = reduce(DataFrame.union, rows).groupBy(F.shiftright("id", 1).alias("id"), "marker").agg(*(F.round(F.max(F.when(F.col("id").bitwiseAND(1) == k, F.col("x"))), 9).alias(c) for k, c in ((0, "o"), (1, "w"))))
    long = view(stored(both.filter("o is not null and w is not null").select("id", F.lit("all").alias("condition"), F.lit("all").alias("model"), "marker", "o", "w")))
    return spark.sql(statistics.comparison_rows(Spark(), f"long AS (SELECT * FROM {long})")).drop("condition", "model")


def compute_empathic_markers(stories: DataFrame) -> DataFrame:
    return merged(stories, EMPATHIC)


def compute_stylometric_markers(stories: DataFrame, include_mfw_individual: bool = False) -> DataFrame:
    return merged(stories, STYLOMETRIC + (["mfw_frequencies"] if include_mfw_individual else []))


def compute_indexical_markers(stories: DataFrame) -> DataFrame:
    return merged(stories, INDEXICAL)
