"""Chat formatting: budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans: a window holds the system
turn, at most ``history`` earlier turns (and at most ``history_share`` of the
budget) as context, and as many new turns as the budget allows (one at least: a
turn over the budget gets a window of its own, marked ``over_budget``).  The loss
mask covers the texts of new assistant turns; system and history turns are
repeated but masked out.

Template: ``[INST]role\\ntext[/INST]``, for assistants ``<s>role\\ntext</s>``.
Control strings inside roles and texts are broken by a backslash after their
first character and backslashes are doubled, so ``unescape(escape(x)) == x`` and
no control string appears in formatted text but the template's own.

Rows are dealt by conversation and sorted by turn; a task streams through them
holding one window (not the conversation), so its memory follows the budget.

Defined cases: null texts and roles are empty; turns sort with nulls first, ties
by role, then text; rows of a null conversation id form one conversation; other
columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_SHARE = 1024, 2, 0.25
# The template's control strings.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_control = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_turn = re.compile(r"(\[INST\]|<s>)((?:\\.|[^\\\n])*)\n(.*?)(\[/INST\]|</s>)", re.S)
_tokens = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def count_tokens(text: str) -> int:
    """Words and punctuation marks, and four for the turn's template."""
    return len(_tokens.findall(text)) + 4


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends in it."""
    opening, closing = ("<s>", "</s>") if role == "assistant" else ("[INST]", "[/INST]")
    head, body = f"{opening}{escape_role(role)}\n", escape(text)
    return head + body + closing, len(head), len(head) + len(body)


def windows(turns, budget: int = BUDGET, history: int = HISTORY, history_share: float = HISTORY_SHARE, tokens=count_tokens):
    """Windows of one conversation from an iterable of (role, text): (repeated
    turns, new turns, tokens), each turn (role, text)."""
    system, past, new, total = [], [], [], 0  # total: prefix sum over the open window

    def opening():
        room, kept, used = history_share * budget, [], 0
        for t in reversed(past[-history:] if history else []):
            if used + t[2] > room:
                break
            kept.insert(0, t)
            used += t[2]
        return system + kept, sum(t[2] for t in system) + used

    repeated = []
    for k, (role, text) in enumerate(turns):
        turn = (role, text, tokens(text))
        if new and total + turn[2] > budget:
            yield repeated, new, total
            past = (past + new)[-history:] if history else []
            past = [t for t in past if t not in system] if system else past
            repeated, used = opening()
            while len(repeated) > len(system) and used + turn[2] > budget:  # history makes room for the turn
                used -= repeated.pop(len(system))[2]
            new, total = [], used
        new.append(turn)
        total += turn[2]
        if k == 0 and role == "system":
            system = [turn]
    if new:
        yield repeated, new, total


def render(repeated, new) -> tuple[str, list[tuple[int, int]]]:
    """The window's text and the (start, end) of its loss spans in code points."""
    out, at, spans = [], 0, []
    for k, (role, text, _) in enumerate(repeated + new):
        s, a, b = format_turn(role, text)
        if k >= len(repeated) and role == "assistant":
            spans.append((at + a, at + b))
        out.append(s)
        at += len(s)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window, read back from its text."""
    return [(unescape(m[2]), unescape(m[3])) for m in _turn.finditer(formatted)]


def _rows(batches):
    for b in batches:
        yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())


def _by_conversation(rows):
    """(conv_id, iterator of its rows) for rows that come sorted."""
    rows = iter(rows)
    head = next(rows, None)
    while head is not None:
        conv, follower = head[0], [None]

        def own(first=head, conv=conv, follower=follower):
            yield first
            for r in rows:
                if r[0] != conv:
                    follower[0] = r
                    return
                yield r
        turns = own()
        yield conv, turns
        for _ in turns:
            pass
        head = follower[0]


WINDOW = "window long, formatted string, loss array<struct<start:long,end:long>>, n_repeated long, n_tokens long, over_budget boolean"


def _format(budget, history, history_share, id_type):
    loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def batch(rows):
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c[0], id_type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()),
             pa.array([[{"start": a, "end": b} for a, b in s] for s in c[3]], loss_type),
             pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64()), pa.array(c[6], pa.bool_())],
            ["conv_id", "window", "formatted", "loss", "n_repeated", "n_tokens", "over_budget"])

    def run(batches):
        out, held = [], 0
        for conv, rows in _by_conversation(_rows(batches)):
            turns = ((r[1], r[2]) for r in rows)
            for k, (repeated, new, total) in enumerate(windows(turns, budget, history, history_share)):
                text, spans = render(repeated, new)
                out.append((conv, k, text, spans, len(repeated), total, total > budget))
                held += len(text)
                if held > 1 << 22:
                    yield batch(out)
                    out, held = [], 0
        if out:
            yield batch(out)
    return run


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_share: float = HISTORY_SHARE) -> DataFrame:
    """Windows of every conversation: conv_id, window, formatted, loss (code
    points of ``formatted``, end exclusive), n_repeated, n_tokens, over_budget.
    A conversation's windows stay together and in order."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = src.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = src.schema["conv_id"].dataType
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(budget, history, history_share, to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {WINDOW}")


def _read_back(id_type):
    def rows(batches):
        for b in batches:
            yield from zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss", "n_repeated")))

    def run(batches):
        out = []
        for conv, ws in _by_conversation(rows(batches)):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, spans, repeated in ws:
                for role, said in parse(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"]:s["end"]])
                    loss.update(said.encode("utf-8", "replace"))
                    loss_chars += len(said)
                chars += len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 10_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    def pack(out):
        c = list(zip(*out))
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from ``format_conversations``' windows as they
    come (in order, one window at a time): conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    return formatted.select("conv_id", "formatted", "loss", "n_repeated").mapInArrow(
        _read_back(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
