"""Chat formatting by prefix-target expansion (operator 3).

Every assistant turn is exploded into an example of its own, a row: all preceding
turns are its context, and only its reply is trainable. A conversation is
rendered once, turn by turn, into segments with character offsets; an example
holds its target and names its context as the rendering's first characters, so a
conversation of n turns costs n rows and not n squared characters.
``materialise`` writes the contexts out too, where a consumer wants it.

Template of a turn: ``### Name: `` + escaped text + ``</turn>\\n``, with the names
System, User and Assistant for the usual roles (any other role is written out with its
length, ``Role=<n>=<role>``). Inside texts and
roles a backslash is doubled, and a backslash goes before each ``###`` and
``</turn>``; so neither marker can arise from content, and reading is exact.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, rows_of

OPEN, CLOSE = "### ", "</turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where the text's span begins and ends in it."""
    head = f"{OPEN}{NAMES.get(role) or f'Role={len(escape(role))}={escape(role)}'}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a rendered turn")
    if segment.startswith(f"{OPEN}Role="):
        digits, _, rest = segment[len(OPEN) + 5 :].partition("=")
        role, rest = rest[: int(digits)], rest[int(digits) :]
        if not rest.startswith(": "):
            raise ValueError("not a rendered turn")
        return unescape(role), unescape(rest[2 : -len(CLOSE)])
    name, _, rest = segment[len(OPEN) :].partition(": ")
    return ROLES[name], unescape(rest[: -len(CLOSE)])


SEGMENTS = "conv_id {kind}, place long, start long, text string, target_start long, target_end long, example long, trainable boolean"


def format_chat(conversations: DataFrame) -> DataFrame:
    """Rendered segments of all conversations, with the examples over them.

    One row per turn: (conv_id, place, start, text, target_start, target_end,
    example, trainable). ``start`` is the segment's offset in the conversation's
    rendering; for a trainable row, example number ``example`` has the characters
    0..target_start as context and target_start..target_end as target, and the
    loss mask covers the target alone.

    Turns are ordered by (turn, role, text), nulls first, which also orders tied
    and repeated rows; all are kept. Null roles and texts are empty; a null
    conv_id is a conversation of its own; other columns are not read. Rows reach
    a task sorted and are streamed, so a long conversation is never held at once.
    """
    import pyarrow as pa

    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        at, place, start, example = object(), 0, 0, 0
        for b in batches:
            out = []
            for conv, role, text in rows_of(b.select(["conv_id", "role", "text"])):
                if conv != at:
                    at, place, start, example = conv, 0, 0, 0
                segment, first, last = render(role, text)
                mine = role == "assistant"
                out.append((conv, place, start, segment, start + first, start + last, example if mine else None, mine))
                place, start, example = place + 1, start + len(segment), example + mine
            kinds = [b.schema.field("conv_id").type, *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 3, pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    rows = conversations.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS.format(kind=kind))


def expand(segments: DataFrame) -> DataFrame:
    """One row per example: (conv_id, example, context_turns, context_chars, target_end, target).

    The context is the first ``context_chars`` characters of the conversation's
    rendering (its first ``context_turns`` turns and the head of the reply), the
    target its characters from there to ``target_end``; the loss mask covers the
    target alone.
    """
    target = F.col("text").substr((F.col("target_start") - F.col("start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    return segments.filter("trainable").select("conv_id", "example", F.col("place").alias("context_turns"), F.col("target_start").alias("context_chars"), "target_end", target.alias("target"))


def materialise(segments: DataFrame, longest: int) -> DataFrame:
    """(conv_id, example, part, context, target) with whole texts: one row, part 0, for examples of up to ``longest`` characters.

    A longer example comes in parts, a row for each turn by number, the target
    with the last one. How much is written grows with the sum of all prefixes.
    """
    t = segments.filter("trainable").select("conv_id", F.col("place").alias("last"), "example", "target_start", "target_end")
    pieces = segments.select("conv_id", "place", "start", F.col("text").alias("piece")).join(t, "conv_id").filter("place <= last")
    whole = pieces.filter(F.col("target_end") <= longest).groupBy("conv_id", "example", "target_start", "target_end").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    cut = lambda text, a, b: text.substr((a + 1).cast("int"), (b - a).cast("int"))
    text, zero = F.concat_ws("", F.col("p.piece")), F.lit(0)
    short = whole.select("conv_id", "example", F.lit(0).cast("long").alias("part"), cut(text, zero, F.col("target_start")).alias("context"), cut(text, F.col("target_start"), F.col("target_end")).alias("target"))
    own, here = F.col("place") == F.col("last"), lambda c: F.col(c) - F.col("start")
    context = F.when(own, cut(F.col("piece"), zero, here("target_start"))).otherwise(F.col("piece"))
    target = F.when(own, cut(F.col("piece"), here("target_start"), here("target_end")))
    return short.unionByName(pieces.filter(F.col("target_end") > longest).select("conv_id", "example", F.col("place").alias("part"), context.alias("context"), target.alias("target")))


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered turns and the examples alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_examples, expanded_chars). Turns and roles are read from the rendering, the
    loss from the examples' targets; an example whose context does not end where
    its target begins in the rendering is an error. ``formatted_chars`` is the
    length of the rendering, ``expanded_chars`` that of all examples written out.

    A digest needs a conversation's turns in order, so they stream through one
    task, which holds a batch of them at a time.
    """
    import pyarrow as pa

    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "expanded_chars"]

    def run(batches):
        class Sums:
            def __init__(self, conv):
                self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
                self.n = self.chars = self.formatted = self.before = self.examples = self.expanded = 0
                self.segment = ""

            def row(self):
                return (self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted, self.examples, self.expanded)

        now: Sums | None = None
        for b in batches:
            out = []
            for conv, is_example, text, context, end in rows_of(b):
                if now is None or conv != now.conv:
                    if now:
                        out.append(now.row())
                    now = Sums(conv)
                if is_example:
                    if now.segment[context - now.before : end - now.before] != text:
                        raise ValueError("an example's target is not where its context ends")
                    target = unescape(text)
                    now.loss.update(target.encode("utf-8", "surrogatepass"))
                    now.chars += len(target)
                    now.examples += 1
                    now.expanded += end
                else:
                    role, plain = parse(text)
                    now.turns.update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
                    now.n += 1
                    now.before, now.segment = now.formatted, text
                    now.formatted += len(text)
            yield pack(out, b.schema.field(0).type)
            kind_ = b.schema.field(0).type
        if now:
            yield pack([now.row()], kind_)

    def pack(rows, k):
        kinds = [k, pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    none = F.lit(None).cast("long")
    turns = segments.select("conv_id", "place", F.lit(False).alias("is_example"), "text", none.alias("context"), none.alias("end"))
    targets = examples.select("conv_id", F.col("context_turns").alias("place"), F.lit(True).alias("is_example"), F.col("target").alias("text"), F.col("context_chars").alias("context"), F.col("target_end").alias("end"))
    s = turns.unionByName(targets).repartition("conv_id").sortWithinPartitions("conv_id", "place", "is_example").drop("place")
    return s.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long")


def chat_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Format, explode into examples, write both, and read back; see ``format_chat``, ``expand`` and ``read_back``."""
    ws = Workspace(spark, "chat")
    segments = ws.save(format_chat(conversations), "segments")
    return read_back(segments, ws.save(expand(segments), "examples"))
