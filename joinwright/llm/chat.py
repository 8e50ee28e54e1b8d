r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and only that reply
trainable. Turns after the last reply (or a conversation without one) make a last example with nothing trainable.

The template is <s>, then [INST] role, line end, text, [/INST] for each turn, then </s>. Inside roles and texts a
backslash is doubled and one is put after the first character of each of these four control strings, so none
of them occurs there; a line end in a role gets a backslash before it. unescape() undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shipped

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile("|".join(map(re.escape, (BOS, EOS, OPEN, CLOSE))))
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text starts and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(example: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted example."""
    if not (example.startswith(BOS) and example.endswith(EOS)):
        raise ValueError("not a formatted example")
    at, turns = len(BOS), []
    while example.startswith(OPEN, at):
        role = _ROLE.match(example, at + len(OPEN))
        end = example.index(CLOSE, role.end())
        turns.append((unescape(role[1]), unescape(example[role.end() : end])))
        at = end + len(CLOSE)
    if at != len(example) - len(EOS):
        raise ValueError("not a formatted example")
    return turns


def _examples(reply_role: str, batch_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["conv", "example", "n_turns", "text", "loss_start", "loss_end"]
        conv, context, chars, example, answered, begun = None, [], 0, 0, True, False
        rows, held = [], 0

        def tail():
            return (conv, example, len(context), BOS + "".join(context) + EOS, None, None)

        def flush():
            out = pd.DataFrame(rows, columns=cols)
            return out.astype({"loss_start": "Int64", "loss_end": "Int64"})

        for pdf in batches:
            for c, role, text in zip(pdf["conv"], pdf["role"], pdf["text"], strict=True):
                c = None if pd.isna(c) else c
                if not begun or c != conv:
                    if begun and not answered:
                        rows.append(tail())
                        held += chars
                    conv, context, chars, example, answered, begun = c, [], 0, 0, True, True
                turn, start, end = format_turn(role, text)
                at = len(BOS) + chars
                context.append(turn)
                chars += len(turn)
                answered = role == reply_role
                if answered:
                    rows.append((conv, example, len(context), BOS + "".join(context) + EOS, at + start, at + end))
                    example += 1
                    held += chars
                if held > batch_chars:
                    yield flush()
                    rows, held = [], 0
        if begun and not answered:
            rows.append(tail())
        if rows:
            yield flush()

    return run


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", reply_role: str = "assistant", batch_chars: int = 4_000_000) -> DataFrame:
    """The examples of all conversations: conv, example, n_turns, text, loss_start, loss_end.

    loss_start and loss_end (code points, end exclusive) bound the reply inside text; both are null in an
    example with nothing trainable. Examples of a conversation follow each other in one partition, in order.
    Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own.
    A null role or text is the empty one; null ids are one conversation. An empty table gives no example.
    The turns of one conversation stream through one task, which holds the context so far: the size of the
    largest example, whatever the number of conversations or examples. Other columns are not read.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    made = shipped(dealt).mapInPandas(_examples(reply_role, batch_chars), "conv string, example long, n_turns long, text string, loss_start long, loss_end long")
    return made.withColumn("conv", F.col("conv").cast(kind))


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, begun, last, loss, loss_chars, chars = None, False, "", None, 0, 0

    def result():
        whole, turns = hashlib.sha256(), parse(last)
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        return (conv, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars)

    cols = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for pdf in batches:
        rows = []
        for c, text, start, end in zip(pdf["conv"], pdf["text"], pdf["loss_start"], pdf["loss_end"], strict=True):
            c = None if pd.isna(c) else c
            if not begun or c != conv:
                if begun:
                    rows.append(result())
                conv, begun, loss, loss_chars, chars = c, True, hashlib.sha256(), 0, 0
            last, chars = text, chars + len(text)
            if not pd.isna(start):
                reply = unescape(text[int(start) : int(end)])
                loss.update(reply.encode())
                loss_chars += len(reply)
        yield pd.DataFrame(rows, columns=cols)
    if begun:
        yield pd.DataFrame([result()], columns=cols)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what expand() made, parsed and unescaped from its output: one row per conversation."""
    kind = examples.schema["conv"].dataType.simpleString()
    named = examples.withColumn("conv", F.col("conv").cast("string"))
    read = shipped(named).mapInPandas(_read_back, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.withColumn("conv", F.col("conv").cast(kind))
