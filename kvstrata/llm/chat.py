"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of the turns' tokens, as a
tokenizer counts them, say where a window must end; each window repeats the system turn and
a limited history of the turns before it, and the loss mask marks each assistant text in
one window only.

Template of a turn: ``### <role>: <text> </turn>`` and a newline. Inside texts, ``\\``,
``###`` and ``</turn>`` get a backslash before them, so any text can be read back; roles
are percent-quoted.

Defined results: null texts and roles count as empty; rows without a conversation id
are one conversation (null) of their own; rows are ordered by turn, then role, then
text, nulls first, and repeated rows are turns of their own; a turn that doesn't fit the
budget together with the system turn has a window to itself, the only kind of window that
may go beyond the budget or lack the system turn; an empty table gives no windows. One turn
of any length is held as a whole, a conversation never is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize, owning
from kvstrata.llm.token_files import encoder

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TOKEN = re.compile(r"\w+|[^\w\s]")
HEAD, TAIL = "### ", " </turn>\n"

WINDOWS = "conv_id bigint, window_no bigint, n_repeated int, n_turns int, n_tokens bigint, formatted string, loss array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def n_tokens(text: str) -> int:
    """Tokens of a turn where no tokenizer is given: words and single signs, and the two
    marks around it."""
    return len(_TOKEN.findall(text)) + 2


def counter(tokenizer: str | None) -> Callable[[str], int]:
    """Tokens of a turn by a tokenizer's file, and the two marks around it."""
    if tokenizer is None:
        return n_tokens
    encode = encoder(tokenizer).packed
    return lambda text: len(encode(text.encode())) // 4 + 2


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn in a window; start and end bound the
    escaped text. Raises if the window is not made of whole turns."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(": ", at)
        end = at
        while True:  # the first end mark without a backslash; an odd run of them escapes it
            end = formatted.index("</turn>", max(end, head + 2))
            back = end
            while formatted[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                break
            end += 1
        if not formatted.startswith(HEAD, at) or formatted[end - 1 : end + 8] != TAIL:
            raise ValueError("malformed window")
        out.append((unquote(formatted[at + len(HEAD) : head]), unescape(formatted[head + 2 : end - 1]), head + 2, end - 1))
        at = end + 8
    return out


class _Window:
    def __init__(self, number: int):
        self.number, self.parts, self.chars, self.tokens, self.loss = number, [], 0, 0, []
        self.turns = self.repeated = 0

    def add(self, role: str, text: str, tokens: int, target: bool, repeated: bool = False) -> None:
        head = f"{HEAD}{quote(role, safe='')}: "
        body = escape(text)
        if target:
            self.loss += [self.chars + len(head), self.chars + len(head) + len(body)]
        self.parts += [head, body, TAIL]
        self.chars += len(head) + len(body) + len(TAIL)
        self.tokens += tokens
        self.turns += 1
        self.repeated += repeated


def windows_of(turns: Iterator[tuple[str, str]], budget: int, history: int, count: Callable[[str], int] = n_tokens) -> Iterator[_Window]:
    """Windows of one conversation, as its turns stream by. Held at a time: the open
    window, the system turn, and at most ``history`` tokens of turns to repeat."""
    window, system = _Window(0), None
    past: list[tuple[str, str, int]] = []
    total, opened = 0, 0  # prefix sum of turn tokens; its value where the window's own turns start
    extra = 0
    for role, text in turns:
        size = count(text)
        if total > opened and total + size - opened + extra > budget:
            yield window
            window = _Window(window.number + 1)
            again, room = [], min(history, budget - size - (system[2] if system else 0))
            fits = system is None or size + system[2] <= budget
            for turn in reversed(past):
                if turn[2] > room or not fits:
                    break
                again.append(turn)
                room -= turn[2]
            if system and fits and not any(turn is system for turn in again):
                again.append(system)
            for r, t, n in reversed(again):
                window.add(r, t, n, False, True)
            opened, extra = total, window.tokens
        if role == "system" and system is None:
            system = (role, text, size)
        window.add(role, text, size, role == "assistant")
        total += size
        past.append(system if system and system[1] is text and system[0] == role else (role, text, size))
        held = sum(n for *_, n in past[1:])
        while len(past) > 1 and held > history:
            past.pop(0)
            held -= past[0][2]
    if window.turns:
        yield window


def format_conversations(conversations: DataFrame, *, budget: int = 1024, history: int = 256, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of all conversations: conv_id, window_no, n_repeated (leading turns that
    repeat earlier ones), n_turns, n_tokens, formatted, and loss (starts and ends of the
    target texts, in characters of ``formatted``).

    One shuffle by conversation and a sort by turn; then turns stream through, so a
    conversation of any length takes bounded memory. Its windows depend on each other
    in order, which is why a conversation is not dealt to several tasks.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = conversations.select(c(conv_col).cast("bigint").alias("conv_id"), c(turn_col).alias("turn"), F.coalesce(c(role_col), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    yield from zip(*(part[x].to_pylist() for x in ("conv_id", "role", "text")), strict=True)

        held: list[tuple] = []
        count = counter(tokenizer)
        for conv, group in _groups(turns()):
            for w in windows_of(group, budget, history, count):
                held.append((conv, w.number, w.repeated, w.turns, w.tokens, "".join(w.parts), w.loss))
                if len(held) >= 200:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, its rows without the key) for rows in order; streams."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def group():
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        g = group()
        yield key, g
        for _ in g:
            pass


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())]
_NAMES = ["conv_id", "window_no", "n_repeated", "n_turns", "n_tokens", "formatted", "loss"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows alone: n_turns, turns_sha256 (role,
    newline, text, newline of each turn not repeated), loss_chars, loss_sha256 (all text
    under the mask, unescaped) and formatted_chars. Windows stream through running
    digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    yield from zip(*(part[x].to_pylist() for x in ("conv_id", "n_repeated", "formatted", "loss")), strict=True)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        out: list[tuple] = []
        for conv, group in _groups(rows()):
            turns, loss, n, masked, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for repeated, formatted, spans in group:
                chars += len(formatted)
                for role, text, *_ in parse(formatted)[repeated:]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    target = unescape(formatted[a:b])
                    masked += len(target)
                    loss.update(target.encode())
            out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return windows.select("conv_id", "window_no", "n_repeated", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window_no").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def round_trip(conversations: DataFrame, **options) -> DataFrame:
    """Format all conversations into a table of the shared store and read it back."""
    windows = materialize(format_conversations(conversations, **options), "chat-windows")
    return owning(digests(windows), windows)
