"""Chat formatting by event-sourced reconstruction.

A log holds the events of conversations in the order of ``seq`` (any orderable
type, structs included):

* ``start`` opens a message and may bring text,
* ``delta`` appends text,
* ``edit`` replaces all text of the message so far,
* ``regenerate`` throws the message's text away and with it every message that
  was opened after this one and before the event; what follows is anew.

The fold keeps, of each message, the events from its last edit or regeneration
on and joins their texts in order. A message is dropped where an earlier one of
its conversation was regenerated after it began, which is a running maximum
over the messages' small columns. Final messages are rendered one by one and
put together in parts of bounded length, so a conversation of any length needs
no row or task that holds all of it. Only a digest of a whole conversation has
to see its parts one after another; it streams over them with a running hash.

Rendering is reversible: a control string inside a text or role gets a
backslash after its first character (one more where there are some already),
and reading takes it away again. The loss mask covers exactly the escaped texts
of the trained roles, in code points of each part.

Defined results: a null text is empty, a null role the empty role; a null
conversation is one like others; rows without a message id belong to one
message of their conversation; events of other kinds are ignored; repeated
events count each; of equal ``seq`` in a message the smaller text comes first;
events about a dropped message do not bring it back; an empty log gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import written

KINDS = ("start", "delta", "edit", "regenerate")
#: Code points of a part, the last message of which may go beyond.
PART_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """A turn is ``turn role text_mark text end``. ``foreign`` are control strings of other formats, escaped as well."""

    turn: str = "<|turn|>"
    text_mark: str = "<|text|>"
    end: str = "<|end|>\n"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)

    def _controls(self) -> list[str]:
        found = [x.strip("\n") for x in (self.turn, self.text_mark, self.end)] + list(self.foreign)
        firsts = {x[0] for x in found}
        if any(len(x) < 2 or x[1] == "\\" or firsts & set(x[1:]) or "\\" in firsts for x in found):
            raise ValueError("a control string's first character must stand nowhere else in any, and no backslash at its start")
        return found

    def _pattern(self) -> tuple[str, str]:
        found = self._controls()
        first = "[" + "".join(re.escape(x) for x in sorted({x[0] for x in found})) + "]"
        return first, "(?:" + "|".join(re.escape(x) for x in sorted({x[1:] for x in found})) + ")"

    def escaped(self, text: Column) -> Column:
        first, rest = self._pattern()
        return F.regexp_replace(text, rf"({first})(\\*{rest})", r"$1\\$2")

    def unescaped(self, text: str) -> str:
        first, rest = self._pattern()
        return re.sub(rf"({first})\\(\\*{rest})", r"\1\2", text)

    def read(self, text: str) -> Iterator[tuple[str, str]]:
        """The (role, text) of each turn of a rendered text; anything else in it is an error."""
        at = 0
        while at < len(text):
            middle, stop = text.find(self.text_mark, at), text.find(self.end, at)
            if not text.startswith(self.turn, at) or middle < 0 or stop < middle:
                raise ValueError("no rendered turn")
            yield self.unescaped(text[at + len(self.turn) : middle]), self.unescaped(text[middle + len(self.text_mark) : stop])
            at = stop + len(self.end)


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """The final messages ``(conv_id, message, start, role, text)`` of a log; ``start`` is the ``seq`` of a message's first event."""
    names = ((conv, "conv_id"), (seq, "seq"), (kind, "kind"), (message, "message"), (role, "role"), (text, "text"))
    rows = events.select(*(F.col(f"`{a}`").alias(b) for a, b in names)).where(F.col("kind").isin(*KINDS))
    own = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(own)
    rows = rows.select("*", reset.alias("reset"), F.min("seq").over(own).alias("start"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(own).alias("again"))
    rows = rows.select("*", F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(own).alias("own_role"))
    live = rows.where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    texts = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    folded = live.groupBy("conv_id", "message").agg(F.first("start").alias("start"), F.first("again").alias("again"), F.first("own_role").alias("role"), texts.alias("texts"))
    folded = folded.select("conv_id", "message", "start", "again", F.coalesce("role", F.lit("")).alias("role"), F.array_join("texts.text", "").alias("text"))
    folded = written(folded, "messages")
    before = Window.partitionBy("conv_id").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1)
    late = folded.select("conv_id", "message", "start", F.max("again").over(before).alias("cut")).where("cut > start")
    late = late.select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"))
    final = folded.join(late, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("message").eqNullSafe(F.col("_m")), "left_anti")
    return final.select("conv_id", "message", "start", "role", "text")


def render(messages: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, message, start, formatted, mask_start, mask_end)`` of each message; the mask is null for roles that are not trained."""
    template = template or Template()
    head = F.concat(F.lit(template.turn), template.escaped(F.coalesce("role", F.lit(""))), F.lit(template.text_mark))
    rows = messages.select("conv_id", "message", "start", head.alias("head"), template.escaped(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce("role", F.lit("")).isin(*template.trained).alias("trained"))
    mask = F.when(F.col("trained"), F.length("head").cast("long"))
    return rows.select("conv_id", "message", "start", F.concat("head", "body", F.lit(template.end)).alias("formatted"), mask.alias("mask_start"), (mask + F.length("body")).alias("mask_end"))


def assemble(pieces: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, part, formatted, masks)``: rendered messages in order, in parts of about ``part_chars`` code points.

    Where a part ends follows from the lengths alone: texts meet only those of
    their own part.
    """
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1))
    place = pieces.select("conv_id", "message", "start", F.length("formatted").cast("long").alias("n")).select("conv_id", "message", F.coalesce(before, F.lit(0)).alias("before"))
    place = place.select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"), "before", F.floor(F.col("before") / part_chars).alias("part"))
    rows = pieces.join(place, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("message").eqNullSafe(F.col("_m")))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("before", "formatted", "mask_start", "mask_end"))).alias("p"))
    first = F.col("p")[0]["before"]
    masks = F.transform(F.filter("p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct((x["before"] - first + x["mask_start"]).alias("start"), (x["before"] - first + x["mask_end"]).alias("end")))
    return parts.select("conv_id", "part", F.array_join("p.formatted", "").alias("formatted"), masks.alias("masks"))


def read_back(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of assembled parts, parsed and hashed in order."""
    template = template or Template()
    kind = parts.schema["conv_id"].dataType.simpleString()
    arrow = parts.select("conv_id").limit(0).toArrow().schema.field(0).type
    fields = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        result = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [arrow, *fields], strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        for batch in batches:
            done = []
            for conv, formatted, masks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(result(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = formatted.as_py()
                for role, text in template.read(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for m in masks.as_py():
                    text = template.unescaped(formatted[m["start"] : m["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([result(state)])

    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "masks")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 400) -> DataFrame:
    """The event log that a chat server would have written for finished rows of a conversation.

    Assistant texts are streamed in deltas, begun once and regenerated; other
    texts are begun as a draft and edited. Rows of one turn go by role, then by
    the text's hash; repeated rows are messages each.
    """
    at = F.struct(F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.monotonically_increasing_id().alias("row"))
    base = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{role}`").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), at.alias("message"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))
    event = lambda k, kind, text: F.struct(k.cast("int").alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    base = base.withColumn("pieces", pieces)
    draft = F.coalesce(F.get("pieces", F.lit(0)), F.lit("...")).alias("text")
    streamed = F.concat(F.array(event(F.lit(0), "start", F.lit("")), event(F.lit(1), "delta", draft), event(F.lit(2), "regenerate", F.lit(""))), F.transform("pieces", lambda x, i: event(i + 3, "delta", x)))
    typed = F.array(event(F.lit(0), "start", draft), event(F.lit(1), "edit", F.col("text")))
    log = base.select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e"))
    return log.select("conv_id", F.struct("message", "e.k").alias("seq"), "e.kind", "message", "role", "e.text")


def format_conversations(events: DataFrame, template: Template | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """The log's conversations as rendered parts, written to the shared folder."""
    pieces = written(render(fold_events(events), template), "rendered")
    return written(assemble(pieces, part_chars), "formatted")
