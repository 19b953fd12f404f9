"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: (conv, message, seq, kind, role, text).
``message`` orders the messages of a conversation, ``seq`` the events of a
message. Kinds: ``message`` opens or replaces a message, ``delta`` appends
streamed text, ``edit`` replaces the text, ``regenerate`` empties it so that
new deltas follow, ``delete`` removes the message.

Spark deals the log by conversation and sorts it by message and sequence; one
mapInArrow folds the events as they stream by, holding one message at a time,
and renders every final message as a chunk of the template. So a conversation
of any length needs the memory of its longest message; its chunks in order
are the formatted conversation. Each chunk carries the span under the loss
mask (assistant texts). ``read_back`` parses chunks again.

Template: ``<|turn|>role NEWLINE text<|end|> NEWLINE``. Inside roles and texts a
backslash is doubled and every control string gets a backslash and a dot after
its first character, which makes it harmless and can be undone exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and of common public templates, harmless inside texts.
CONTROLS = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]",
            "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
DELTA_CHARS = 512
KINDS = ("message", "delta", "edit", "regenerate", "delete")
CHUNKS = "conv_id bigint, n bigint, chunk string, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "" if m[1] == "." else "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(chunk, start and end of the text in it). A role is one line."""
    head = TURN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse(chunk: str) -> tuple[str, str]:
    """(role, text) of a chunk."""
    if not (chunk.startswith(TURN) and chunk.endswith(END + "\n")):
        raise ValueError("not a chunk of this template")
    role, text = chunk[len(TURN):-len(END) - 1].split("\n", 1)
    return unescape(role), unescape(text)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events -> chunks; one message is held at a time."""
    here, role, parts, alive, conv, n = None, "", [], False, object(), 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal n
        if here is not None and alive:
            chunk, a, b = render(role, "".join(parts))
            learn = role == "assistant"
            out.append((here[0], n, chunk, a if learn else None, b if learn else None))
            n += 1

    def emit() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 2 else pa.int64()) for i, c in enumerate(cols)],
                                          ["conv_id", "n", "chunk", "loss_start", "loss_end"])

    for batch in batches:
        for c, m, kind, r, text in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, m) != here:
                close()
                if here is None or c != conv:
                    conv, n = c, 0
                here, role, parts, alive = (c, m), "", [], False
            if kind == "delete":
                alive = False
                continue
            alive = True
            role = r if r is not None else role
            if kind == "delta":
                parts.append(text or "")
            else:
                parts = [] if kind == "regenerate" else [text or ""]
            if len(parts) > 4096:
                parts = ["".join(parts)]
        if len(out) >= 1000:
            yield emit()
    close()
    if out:
        yield emit()


def reconstruct(log: DataFrame) -> DataFrame:
    """Chunks (CHUNKS) of a log with columns conv, message (any order-able
    type), seq, kind, role, text. Chunks of a conversation lie in one
    partition, in order of ``n``. A null conv is a conversation of its own, a null role is
    empty unless an earlier event of the message names one, null text is
    empty. Events with equal (conv, message, seq) are taken in the order of kind, role and text.
    Unknown kinds replace the text, as ``edit`` does. An empty log gives no chunks."""
    keys = ["conv", "message", "seq", "kind", "role", "text"]
    return (log.select(*keys).repartition("conv").sortWithinPartitions(*keys)
            .select("conv", F.xxhash64("message").alias("_m"), "kind", "role", "text")
            .mapInArrow(_fold, CHUNKS))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order -> one row per conversation, parsed from the chunks alone."""
    rows: list[tuple] = []
    first, conv = True, None
    state: list = []

    def done() -> None:
        turns, n, loss, chars, total = state
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    def emit() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(DIGEST_COLUMNS))
        rows.clear()
        return made

    for batch in batches:
        for c, chunk, a, b in zip(*(x.to_pylist() for x in batch.columns)):
            if first or c != conv:
                if not first:
                    done()
                first, conv, state = False, c, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = parse(chunk)
            state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[1] += 1
            if a is not None:
                learnt = unescape(chunk[a:b])
                state[2].update(learnt.encode("utf-8", "surrogatepass"))
                state[3] += len(learnt)
            state[4] += len(chunk)
        if len(rows) >= 1000:
            yield emit()
    if not first:
        done()
    if rows:
        yield emit()


DIGEST_COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation (DIGEST_COLUMNS) from chunks that lie in order
    of conversation and ``n``, as ``reconstruct`` returns them."""
    return chunks.select("conv_id", "chunk", "loss_start", "loss_end").mapInArrow(
        _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """An event log of a table (conv_id, turn, role, text), as a service would have kept it: every row opens its
    message; assistant texts arrive as deltas of ``delta_chars`` code points. By a hash of the row
    an assistant's message was streamed otherwise first and regenerated, another
    one was opened with other words and edited, and before some stood a message that was deleted; what
    is left in the end are the table's rows. Rows with equal conv_id and turn are messages of their own, in the order of
    role and text (its first 128 code points, then its hash); identical rows stay as many messages as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", text.alias("text"))
            .groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_h", F.pmod(F.xxhash64("conv", "turn", "text"), F.lit(8))))
    # copy 0 is the message that was deleted
    rows = rows.withColumn("copy", F.explode(F.sequence(F.when(F.col("_h") == 0, 0).otherwise(1).cast("bigint"), F.col("_n"))))
    message = F.struct("turn", "role", F.substring("text", 1, 128).alias("start"), F.xxhash64("text").alias("hash"), "copy")
    streamed = F.coalesce(F.col("role") == "assistant", F.lit(False))
    draft = F.reverse(F.substring("text", 1, 128))

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.cast("string").alias("text"))

    # cut in one pass over the text
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), 0), lambda x: event("delta", x))
    opened = F.array(event("message", F.lit("")))
    events = (F.when(F.col("copy") == 0, F.array(event("message", draft), event("delete", F.lit(None))))
              .when(streamed & (F.col("_h") % 2 == 1), F.concat(opened, F.array(event("delta", draft), event("regenerate", F.lit(None))), deltas))
              .when(streamed, F.concat(opened, deltas))
              .when(F.col("_h") % 2 == 1, F.array(event("message", draft), event("edit", F.col("text"))))
              .otherwise(F.array(event("message", F.col("text")))))
    return (rows.select("conv", message.alias("message"), "role", F.posexplode(events).alias("seq", "e"))
            .select("conv", "message", "seq", "e.kind", "role", "e.text"))


def op9_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back. Nulls, empty texts, repeated rows
    and an empty table: see ``events_of`` and ``reconstruct``; of an empty table conversation -1 is left."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id bigint, turn bigint, role string, text string")
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_back(reconstruct(events_of(given.unionByName(own))))


ship(__name__)
