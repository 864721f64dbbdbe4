"""Conversations as training records: windows of whole turns within a token budget.

Method: turns are cut into stretches of ``STRETCH`` turn numbers, so that one endless conversation is many small groups. In a stretch,
prefix sums of turn tokens choose the longest run of turns that fits the budget beside the system turn and the history; a turn that
is longer than the budget is a window of its own. Every window begins with the conversation's system turn, then repeats the last
turns before its run as far as they fit ``history`` tokens (in the stretch before at most). Only assistant turns of the run itself
are under the loss mask, so a repeated target is masked.

A turn is written ``### role: text</turn>`` and a line end. Inside texts and roles a backslash stands before ``###``, ``</turn>`` and
every backslash, in roles before a colon too; dropping it gives the original back.

Defined cases: null text and null role are empty. Turns are ordered by turn, then role, then text, nulls first; repeated turns are
turns of their own. A null conv_id is one conversation. The system turn is the first turn, if its role is ``system``. Columns beside
the four are not looked at; an empty table has no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

STRETCH = 256
SYSTEM, HISTORY, OWN = 0, 1, 2

WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("stretch", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("repeated", pa.int32()),
    ("n_turns", pa.int32()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("tokens", pa.int64())])
WINDOWS_TYPE = ("conv_id long, stretch long, window int, formatted string, repeated int, n_turns int, loss_starts array<int>, "
                "loss_ends array<int>, tokens long")

_CONTROL, _ROLE, _ESCAPED = re.compile(r"\\|</turn>|###"), re.compile(r"\\|</turn>|###|:"), re.compile(r"\\(.)", re.DOTALL)
_END, _COLON = re.compile(r"\\.|</turn>\n", re.DOTALL), re.compile(r"\\.|: ", re.DOTALL)


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _until(text: str, pattern: re.Pattern, at: int) -> tuple[int, int]:
    """Place and end of the next mark that no backslash hides."""
    for found in pattern.finditer(text, at):
        if found[0][0] != "\\":
            return found.start(), found.end()
    raise ValueError("a turn without its end")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window: role and text as they were."""
    out, at = [], 0
    while at < len(formatted):
        colon, body = _until(formatted, _COLON, at + 4)
        stop, after = _until(formatted, _END, body)
        out.append((unescape(formatted[at + 4: colon]), unescape(formatted[body:stop])))
        at = after
    return out


def turn_tokens(role: str = "role", text: str = "text") -> Column:
    """Cost of a turn: a token for each four code points begun, marks included."""
    return F.ceil((F.length(role) + F.length(text) + F.lit(14)) / F.lit(4)).cast("long")


def _build(budget: int, history: int):
    def task(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
        system = [r for r in rows if r["kind"] == SYSTEM]
        before = [r for r in rows if r["kind"] == HISTORY]
        own = [r for r in rows if r["kind"] == OWN]
        line = before + own
        cost = np.array([r["cost"] for r in line], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(cost)])
        room = budget - sum(r["cost"] for r in system)
        out: dict[str, list] = {f.name: [] for f in WINDOWS}
        start, number = len(before), 0
        while start < len(line) or (number == 0 and system and system[0]["first"]):
            # The earliest turn from which the turns before the run still fit the history.
            back = int(np.searchsorted(total, total[start] - history, side="left"))
            if start < len(line):  # less history where the next turn would not fit beside it
                back = max(back, min(start, int(np.searchsorted(total, total[start + 1] - room, side="left"))))
            used = int(total[start] - total[back])
            stop = int(np.searchsorted(total, total[start] + max(0, room - used), side="right")) - 1
            stop = min(len(line), max(stop, start + 1))
            new_system = bool(system) and system[0]["first"] and number == 0
            repeated = (len(system) if not new_system else 0) + start - back
            text, length, starts, ends, count = [], 0, [], [], 0
            # A new system turn is the first turn of all, so that nothing repeated stands before it.
            for k, r in enumerate(system + line[back:stop]):
                head, body = f"### {escape(r['role'], _ROLE)}: ", escape(r["text"])
                if k >= repeated:
                    count += 1
                    if r["role"] == "assistant":
                        starts.append(length + len(head))
                        ends.append(length + len(head) + len(body))
                text.append(f"{head}{body}</turn>\n")
                length += len(text[-1])
            for name, value in zip(WINDOWS.names, (
                    table["conv_id"][0].as_py(), table["stretch"][0].as_py(), number, "".join(text), repeated, count, starts, ends,
                    int(total[stop] - total[back]) + budget - room)):
                out[name].append(value)
            start, number = stop, number + 1
        return pa.table(out, schema=WINDOWS)
    return task


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """One row per window: conv_id, stretch and window (their order), formatted, repeated (how many of its first turns stand in
    earlier windows), n_turns (the others), loss_starts and loss_ends (code points of formatted under the loss mask), tokens."""
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = plain.select("*", turn_tokens().alias("cost"), F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH).cast("long").alias("stretch"))
    stretches = rows.select("conv_id", "stretch").distinct()
    order = Window.partitionBy("conv_id").orderBy("stretch")
    stretches = stretches.select("*", F.lead("stretch").over(order).alias("next"), F.lag("stretch").over(order).isNull().alias("first"))
    inside = Window.partitionBy("conv_id", "stretch")
    up, down = [F.asc_nulls_first("turn"), "role", "text"], [F.desc_nulls_last("turn"), F.desc("role"), F.desc("text")]
    marked = rows.select("*", F.row_number().over(inside.orderBy(*up)).alias("n"),
                         F.sum("cost").over(inside.orderBy(*down).rowsBetween(Window.unboundedPreceding, 0)).alias("tail"))
    here = stretches.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), "next", "first")
    placed = marked.join(here, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).drop("c", "s")
    head = F.col("first") & (F.col("n") == 1) & (F.col("role") == "system")
    columns = ["conv_id", "turn", "role", "text", "cost"]
    own = placed.filter(~head).select(*columns, "stretch", F.lit(OWN).alias("kind"), F.lit(False).alias("first"))
    tail = placed.filter(~head & (F.col("tail") <= history) & F.col("next").isNotNull()).select(
        *columns, F.col("next").alias("stretch"), F.lit(HISTORY).alias("kind"), F.lit(False).alias("first"))
    system = (placed.filter(head).select(*columns).join(here, F.col("conv_id").eqNullSafe(F.col("c")))
              .select(*columns, F.col("s").alias("stretch"), F.lit(SYSTEM).alias("kind"), "first"))
    return (own.unionByName(tail).unionByName(system).groupBy("conv_id", "stretch")
            .applyInArrow(_build(budget, history), WINDOWS_TYPE))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From formatted windows alone: their new turns, and the text under the loss mask."""
    for batch in batches:
        turns, loss = [], []
        for row in batch.to_pylist():
            text = row["formatted"]
            turns.append("".join(f"{role}\n{body}\n" for role, body in parse(text)[row["repeated"]:]))
            loss.append("".join(unescape(text[a:b]) for a, b in zip(row["loss_starts"], row["loss_ends"])))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("conv_id", "stretch", "window", "n_turns")), pa.array(turns, pa.string()), pa.array(loss, pa.string()),
             pa.array([len(t) for t in batch.column("formatted").to_pylist()], pa.int64())],
            ["conv_id", "stretch", "window", "n_turns", "turns", "loss", "chars"])


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests of sorted windows; only the current conversation's state is held."""
    key, state = None, None

    def done() -> tuple:
        return (key, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    out.append(done())
                key, state = row["conv_id"], {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            state["n"] += row["n_turns"]
            state["turns"].update(row["turns"].encode())
            state["loss"].update(row["loss"].encode())
            state["loss_chars"] += len(row["loss"])
            state["chars"] += row["chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(DIGESTS)], schema=DIGESTS)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(done(), DIGESTS)], schema=DIGESTS)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: number and digest of all turns, length and digest of the text under the loss
    mask, total length of the windows. A digest of one text has to run through it in order: a conversation's windows stream
    through one task, which holds a batch of them."""
    return (windows.mapInArrow(_read_back, "conv_id long, stretch long, window int, n_turns int, turns string, loss string, chars long")
            .repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
