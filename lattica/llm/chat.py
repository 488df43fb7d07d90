"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into an example of its own: all turns before it are its context, and
only its reply is trainable. Rows of `examples`, in order within a conversation:

- example: the context, the reply, and the loss span, in code points of the two together;
- rest: the turns after the last reply, as a context without a reply, so that no turn is lost;
- segment: a long context's beginning, once. Contexts grow with a conversation, so all of them
  together would grow with its square; what is beyond `segment_chars` code points is cut off between
  turns as a segment, and a row's context follows on the first `segments` segments of its
  conversation. With `segment_chars` None every context is written out as a whole.

Template: `<|im_start|>role`, a newline, the text, `<|im_end|>` and a newline. In roles and texts a
backslash becomes two and `<|` becomes `<\\|`, so the control strings stand only where the template
puts them, and the reverse is exact; in roles a newline becomes `\\n`.

Turns go by (turn, role, text), nulls first; equal turns stay as often as they occur. Null role or
text is empty. Turns without a conv_id make one conversation of their own. Roles are compared as
they are: only `assistant` is trainable. Extra columns aren't read.

A conversation's turns are dealt by conv_id and sorted on disk, and each task streams over them,
holding what follows the last segment, so memory doesn't grow with a conversation. A digest of an
ordered sequence can't be computed in parts, so one conversation is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.llm.common import ship

START, END = "<|im_start|>", "<|im_end|>\n"
#: Code points of context that a row holds itself, at most.
SEGMENT_CHARS = 32_768
#: Code points of one batch of rows, about.
BATCH_CHARS = 4_000_000


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The reverse of escape(), and of the newline in roles."""
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        j = text.find("\\", i)
        if j < 0:
            out.append(text[i:])
            break
        out.append(text[i:j])
        c = text[j + 1 : j + 2]
        out.append("\n" if c == "n" else c)
        i = j + 2
    return "".join(out)


def formatted(turns: DataFrame) -> DataFrame:
    """Chunk rows in order within a conversation: conv_id, chunk, loss_start, loss_end (in the chunk; null but for the assistant's)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    start = F.when(F.col("role") == "assistant", F.length("head"))
    return dealt.select("conv_id", F.concat("head", "body", F.lit(END)).alias("chunk"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def examples(turns: DataFrame, segment_chars: int | None = SEGMENT_CHARS) -> DataFrame:
    """conv_id, kind, number (of the example or segment, from 1), segments, context_chars, context, reply, loss_start, loss_end; see the module's docstring."""
    ship(turns.sparkSession)
    chunks = formatted(turns)
    schema = T.StructType([T.StructField("conv_id", chunks.schema["conv_id"].dataType), T.StructField("kind", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("number", "segments", "context_chars")), T.StructField("context", T.StringType()), T.StructField("reply", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])
    arrow = to_arrow_schema(schema)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        conv, tail, size, before, segments, n, open_turns = None, [], 0, 0, 0, 0, False
        began = False

        def rest() -> list[tuple]:
            return [(conv, "rest", n + 1, segments, before + size, "".join(tail), None, None, None)] if open_turns else []

        for b in batches:
            for new, chunk, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "loss_start", "loss_end")), strict=True):
                if not began or new != conv:
                    rows += rest()
                    began, conv, tail, size, before, segments, n = True, new, [], 0, 0, 0, 0
                if segment_chars is not None and size >= segment_chars:
                    segments += 1
                    rows.append((conv, "segment", segments, segments - 1, before, "".join(tail), None, None, None))
                    tail, size, before = [], 0, before + size
                open_turns = start is None
                if start is not None:
                    n += 1
                    shift = before + size
                    rows.append((conv, "example", n, segments, shift, "".join(tail), chunk, shift + start, shift + end))
                    held += size
                tail.append(chunk)
                size += len(chunk)
                held += len(chunk)
                if held > BATCH_CHARS:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
        rows += rest()
        if rows:
            yield _batch(rows, arrow)

    return chunks.mapInArrow(expand, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def parse(chunk: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not chunk.startswith(START) or not chunk.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, text = chunk[len(START) : len(chunk) - len(END)].partition("\n")
    return unescape(role), unescape(text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns one after the other."""
    return [parse(x + END) for x in text.split(END)[:-1]]


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("n_examples", T.LongType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def read_back(shown: DataFrame) -> DataFrame:
    """Per conversation, from the rows of examples(): turns, digests and lengths.

    Turns are those of the segments and of the last row, whose context and reply go to the
    conversation's end; the loss is each example's own span. formatted_chars sums the lengths of all
    examples, context and reply. An example whose context isn't as long as it says is an error.
    """
    ship(shown.sparkSession)
    schema = T.StructType([T.StructField("conv_id", shown.schema["conv_id"].dataType), *DIGEST.fields[1:]])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        began, conv = False, None
        n = examples = loss = chars = before = 0
        turns, mask, last = hashlib.sha256(), hashlib.sha256(), ""

        def take(text: str) -> int:
            found = turns_of(text)
            turns.update("".join(f"{role}\n{said}\n" for role, said in found).encode())
            return len(found)

        def close() -> None:
            if began:
                rows.append((conv, n + take(last), turns.hexdigest(), examples, loss, mask.hexdigest(), chars))

        for b in batches:
            for new, kind, size, context, reply, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "context_chars", "context", "reply", "loss_start", "loss_end")), strict=True):
                if not began or new != conv:
                    close()
                    began, conv = True, new
                    n = examples = loss = chars = before = 0
                    turns, mask, last = hashlib.sha256(), hashlib.sha256(), ""
                if kind == "segment":
                    n += take(context)
                    before += len(context)
                    last = ""
                    continue
                if before + len(context) != size:
                    raise ValueError("a context's segments are missing")
                last = context + (reply or "")
                if reply is not None:
                    said = unescape(reply[start - size : end - size])
                    examples += 1
                    loss += len(said)
                    mask.update(said.encode())
                    chars += size + len(reply)
            if len(rows) >= 10_000:
                yield _batch(rows, arrow)
                rows.clear()
        close()
        if rows:
            yield _batch(rows, arrow)

    return shown.select("conv_id", "kind", "context_chars", "context", "reply", "loss_start", "loss_end").mapInArrow(read, schema)


def digests(turns: DataFrame) -> DataFrame:
    return read_back(examples(turns))
