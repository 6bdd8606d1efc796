"""One relational text for two engines: how Spark SQL and DuckDB spell the same expression."""

from __future__ import annotations


#: Bytes of input files for each partition of the texts.
PART_BYTES = 8 << 20


class Spark:
    """partitions: how many the texts are dealt over, so that a task's share does not grow with them; the session's setting where not given."""

    spark = True

    def __init__(self, partitions: int | None = None) -> None:
        self.partitions = partitions

    def s(self, text: str) -> str:
        """A string literal, backslashes as they are."""
        return "r'" + text.replace("'", "\\'") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def tokens(self, x, pattern=r"\p{L}+"):
        return f"regexp_extract_all({x}, {self.s(pattern)}, 0)"

    def count(self, x, pattern):
        return f"regexp_count({x}, {self.s(pattern)})"

    def matches(self, x, pattern):
        return f"({x} RLIKE {self.s(pattern)})"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(to)})"

    def split(self, x, pattern):
        return f"split({x}, {self.s(pattern)})"

    def size(self, x):
        return f"size({x})"

    def filter(self, x, v, cond):
        return f"filter({x}, {v} -> {cond})"

    def map(self, x, v, e):
        return f"transform({x}, {v} -> {e})"

    def distinct(self, x):
        return f"array_distinct({x})"

    def both(self, x, y):
        return f"array_intersect({x}, {y})"

    def explode(self, x):
        return f"explode({x})"

    def array(self, items):
        return "array(" + ", ".join(items) + ")"

    def some(self, x):
        """The list, or one null where it is empty: its row survives being exploded."""
        return f"CASE WHEN {self.size(x)} = 0 THEN {self.array(['CAST(NULL AS STRING)'])} ELSE {x} END"

    def cat(self, lists):
        return "concat(" + ", ".join(lists) + ")"

    def gather(self, x, cond, order=None):
        """The values of a group as a list, nulls and other rows left out; empty where there is none."""
        return f"collect_list(CASE WHEN {cond} THEN {x} END)" if order is None else f"transform(array_sort(collect_list(CASE WHEN {cond} THEN struct({order} AS k, {x} AS x) END)), p -> p.x)"

    def top(self, x):
        return f"array_max({x})"

    def fold(self, x, start, state, item, e):
        """Left fold; ``start`` and the step are dicts of field and expression, all doubles."""
        struct = lambda f: "named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in f.items()) + ")"
        return f"aggregate({x}, {struct(start)}, ({state}, {item}) -> {struct(e)})"

    def levenshtein(self, x, y):
        """Edit distance by character."""
        return f"levenshtein({x}, {y})"

    def best(self, key, value):
        return f"min(struct({key} AS k, {value} AS v)).v"

    def unpivot(self, cols):
        return "inline(array(" + ", ".join(f"struct('{c}' AS marker, CAST({c} AS DOUBLE) AS value)" for c in cols) + "))"

    def ngrams(self, x, longest):
        """All grams of 2 .. longest characters, each size made from the one before: linear in the text's length."""
        step = lambda g, k: f"zip_with({g}, slice(cs, {k}, greatest(size(cs) - {k - 1}, 0)), (a, b) -> a || b)"
        e = "concat(" + ", ".join(f"g{k}" for k in range(2, longest + 1)) + ")"
        for k in range(longest, 1, -1):
            e = f"transform(array({step(f'g{k - 1}' if k > 2 else 'cs', k)}), g{k} -> {e})[0]"
        return f"filter(transform(array(split({x}, '')), cs -> {e})[0], g -> g IS NOT NULL)"

    def json(self, x, path):
        return f"get_json_object({x}, '$.{path}')"

    def sumlist(self, x):
        return f"aggregate({x}, CAST(0 AS DOUBLE), (acc, v) -> acc + v)"

    def seq(self, a, b):
        return f"sequence({a}, {b})"

    def dot(self, x, y):
        return f"aggregate(zip_with({x}, {y}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), CAST(0 AS DOUBLE), (acc, v) -> acc + v)"

    def near(self, by):
        return f"/*+ REPARTITION({by}) */" if self.partitions is None else f"/*+ REPARTITION({self.partitions}, {by}) */"

    def struct(self, fields):
        """A record; values that are dicts are records inside it."""
        return "named_struct(" + ", ".join(f"'{k}', {self.struct(v) if isinstance(v, dict) else v}" for k, v in fields.items()) + ")"

    def to_json(self, fields):
        return f"to_json({self.struct(fields)})"


class Duck(Spark):
    spark = False

    def s(self, text):
        return "'" + text.replace("'", "''") + "'"

    def tokens(self, x, pattern=r"\p{L}+"):
        return f"regexp_extract_all({x}, {self.s(pattern)})"

    def count(self, x, pattern):
        return f"len(regexp_extract_all({x}, {self.s(pattern)}))"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, {self.s(pattern)})"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(to)}, 'g')"

    def split(self, x, pattern):
        return f"string_split_regex({x}, {self.s(pattern)})"

    def size(self, x):
        return f"len({x})"

    def filter(self, x, v, cond):
        return f"list_filter({x}, lambda {v}: {cond})"

    def map(self, x, v, e):
        return f"list_transform({x}, lambda {v}: {e})"

    def distinct(self, x):
        return f"list_distinct({x})"

    def both(self, x, y):
        return f"list_intersect({x}, {y})"

    def explode(self, x):
        return f"unnest({x})"

    def array(self, items):
        return "[" + ", ".join(items) + "]"

    def cat(self, lists):
        out = lists[-1]
        for x in reversed(lists[:-1]):
            out = f"list_concat({x}, {out})"
        return out

    def gather(self, x, cond, order=None):
        return f"coalesce(list({x}{'' if order is None else f' ORDER BY {order}'}) FILTER (WHERE {cond}), [])"

    def top(self, x):
        return f"list_max({x})"

    def fold(self, x, start, state, item, e):
        struct = lambda f: "{" + ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in f.items()) + "}"
        return f"list_reduce({x}, lambda {state}, {item}: {struct(e)}, {struct(start)})"

    def levenshtein(self, x, y):
        """This engine counts bytes: a pair's other characters are first mapped to control characters (26 of them)."""
        other = f"array_to_string(list_distinct(regexp_extract_all({x} || {y}, '[^\\x00-\\x7F]')), '')"
        controls = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)])
        one = lambda t: f"translate({t}, {other}, substr({controls}, 1, length({other})))"
        return f"levenshtein({one(x)}, {one(y)})"

    def best(self, key, value):
        return f"arg_min({value}, ({key}, {value}))"

    def unpivot(self, cols):
        return "unnest([" + ", ".join(f"{{'marker': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in cols) + "], recursive := true)"

    def ngrams(self, x, longest):
        return self.cat([f"list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))" for n in range(2, longest + 1)])

    def json(self, x, path):
        return f"json_extract_string({x}, '$.{path}')"

    def sumlist(self, x):
        return f"coalesce(list_sum({x}), 0)"

    def seq(self, a, b):
        return f"generate_series({a}, {b})"

    def dot(self, x, y):
        return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

    def near(self, by):
        return ""

    def struct(self, fields):
        return "struct_pack(" + ", ".join(f"{k} := {self.struct(v) if isinstance(v, dict) else v}" for k, v in fields.items()) + ")"


def r(x: str, digits: int = 6) -> str:
    """Rounded, and without a negative zero."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def words_in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def upper_tail(x: str) -> str:
    """P(Z > x) for x >= 0 in double precision, by the published rational approximation."""
    # Fixed values of the approximation.
    top = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    low = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

    def horner(cs):
        e = f"CAST({cs[0]!r} AS DOUBLE)"
        for c in cs[1:]:
            e = f"({e} * {x} + CAST({c!r} AS DOUBLE))"
        return e

    near = f"exp(-{x} * {x} / 2) * {horner(top)} / {horner(low)}"
    far = f"exp(-{x} * {x} / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65))))) / CAST(2.506628274631 AS DOUBLE)"
    return f"(CASE WHEN {x} > 37 THEN CAST(0 AS DOUBLE) WHEN {x} < CAST(7.07106781186547 AS DOUBLE) THEN {near} ELSE {far} END)"
