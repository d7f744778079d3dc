"""Removal of passages that repeat across documents, by recompression.

Recompression rewrites all texts in rounds. In each round, runs of one symbol become one
symbol, and of the other symbols, dealt to a left and a right side by their names, each
left-right pair becomes one symbol. A round is two jobs:

- Naming. Texts, in blocks of a few MB, ask for the names of their distinct runs and
  pairs; a shuffle brings equal ones of all blocks together. Two different ones never get
  one name, as all of what a name stands for is compared, down to words, whose names are
  checked against a second, independent hash. The answer also says whether other
  documents have the symbol, and whether one with a smaller id has it.
- Rewriting. Blocks take the answers and put the named symbols in place. A symbol that
  only one document has ends there: nothing that holds it can repeat. Each symbol carries
  the span of words that its making depended on. Equal windows of 13 words hold equal
  symbols wherever that span lies inside the window, so a window with a symbol of one
  document inside is unique and drops out, and with it all symbols that no open window
  touches. After two or three rounds little but repeated text is left.
- A symbol of 13 words or more that a document with a smaller id has shows that all its
  words repeat, and settles the windows inside it.

Windows still open after the last round lie at the ends of repeated passages, or in ones
too short for a symbol. They are judged by one more naming: a window's name comes from its
words' names, and is compared by 128 bits that start from both hashes of the words. The
first document with a window never drops out before, as its symbols are shared or it has no
equal window; so the result is complete whatever the rounds have settled.

A block asks once for a symbol, however often it has it, so a frequent passage costs one
row a block. A task holds one block's words, or one group of names; groups grow in number
with the text. Blocks with their texts are shuffled three times, symbols once a round.

Defined results: a null text has no words; rows without an id are kept whole and count
for no other; rows that share an id are one document as to what is smaller, and each
is judged by its own words; an empty table gives no rows. A very long text is a block of
its own. Only the id and text columns are read, so extra columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import dealt, group_of, hash_texts, materialize, mix, owning, pack, pieces, release, unpack, window_hashes

WINDOW = 13
_U = np.uint64
_ONE = _U(1)
_FAR = WINDOW + 1  # a span that reaches further can't lie in a window
#: What a name stands for.
PAIR, RUN, SPAN, WORD = range(4)
#: Answers: only this document has it; others have it, but none before the block's first; one before has it.
ALONE, SHARED, EARLIER = range(3)
#: Added to the answer if the name was taken; the symbol gets its second name.
_RENAMED = 4

_TEXT, _STATE, _ASK, _ANSWER, _CLASH = range(5)
ROWS = "kind int, blk bigint, grp bigint, payload binary, open binary, gone binary, ids array<bigint>, sizes array<int>"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _row(kind: int, blk: int, **values) -> pa.RecordBatch:
    return _batch([(kind, blk, values)])


def _batch(rows: list[tuple[int, int, dict]]) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], [r[1] for r in rows], *([r[2].get(c) for r in rows] for c in _NAMES[2:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _packed(texts: list[bytes | None]) -> dict:
    """Texts of a block as one compressed string, with their lengths (-1: null)."""
    import zstandard

    return {"payload": zstandard.compress(b"".join(t or b"" for t in texts), 1), "sizes": [-1 if t is None else len(t) for t in texts]}


def _texts(row: dict) -> list[bytes | None]:
    import zstandard

    raw, at, out = zstandard.decompress(row["payload"]), 0, []
    for n in row["sizes"]:
        out.append(None if n < 0 else raw[at : at + n])
        at += max(n, 0)
    return out


def name_of(x1: np.ndarray, x2: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Names of pairs (two symbols), runs (symbol, length) and windows (two fingerprints). A
    word's is its first hash, whatever its second."""
    return np.where(kind == WORD, x1, mix(mix(x1 ^ (kind.astype(_U) * _U(0xA0761D6478BD642F))) * _U(0xD6E8FEB86659FD93) + x2))


def second_name(x1: np.ndarray, x2: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return mix(mix(x2 + _U(0x9FB21C651E98DF25)) * _U(0xC2B2AE3D27D4EB4F) + mix(x1) + kind.astype(_U))


def by_groups(starts: np.ndarray, head: np.ndarray, how) -> np.ndarray:
    return how.reduceat(starts, head) if len(head) else starts[:0]


class Question:
    """Distinct (x1, x2, kind) of a block, with the least and greatest id of each."""

    def __init__(self, x1: np.ndarray, x2: np.ndarray, kind: np.ndarray, ids: np.ndarray, groups: int):
        name = name_of(x1, x2, kind)
        order = np.argsort(name)
        s, n1, n2 = name[order], x1[order], x2[order]
        differ = (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])
        if ((s[1:] == s[:-1]) & differ).any():  # names that clash
            order = np.lexsort((x2, x1, name))
            n1, n2 = x1[order], x2[order]
            differ = (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])
        new = np.concatenate(([True], differ)) if len(name) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.of = np.empty(len(name), np.int64)  # which of the distinct ones each is
        self.of[order] = np.cumsum(new) - 1
        self.name, self.x1, self.x2, self.kind = name[order[head]], n1[head], n2[head], kind[order[head]]
        self.lo, self.hi = by_groups(ids[order], head, np.minimum), by_groups(ids[order], head, np.maximum)
        self.groups = groups

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(group, which of the distinct ones go there)."""
        for g, (at,) in dealt(group_of(self.name, self.groups), [np.arange(len(self.name))]):
            yield g, at

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        for g, at in self.parts():
            base = int(self.lo[at].min())
            yield g, np.int64(base).tobytes() + pack([self.x1[at], self.x2[at], self.kind[at], self.lo[at] - base, self.hi[at] - self.lo[at]])

    def answers(self, found: dict[int, bytes]) -> np.ndarray:
        """One answer for each of the distinct ones."""
        out = np.zeros(len(self.name), np.uint8)
        for g, at in self.parts():
            out[at] = np.frombuffer(found[g], np.uint8)
        return out


def named(g: int, rows: list[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Answers to all that blocks ask of one group: rows of (block, x1, x2, kind, least and
    greatest id)."""
    x1, x2, kind, lo, hi = (np.concatenate(c) for c in zip(*(r for _, r in rows), strict=True))
    x1, x2 = x1.astype(_U), x2.astype(_U)
    name = name_of(x1, x2, kind)
    taken = np.zeros(len(name), bool)
    order = np.argsort(name)
    s, a, b, k = name[order], x1[order], x2[order], kind[order]
    mixed = (s[1:] == s[:-1]) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1]))
    if mixed.any():
        if (k[1:][mixed] == WORD).any():
            yield _row(_CLASH, 0)
        order = np.lexsort((kind, x2, x1, name))
        s, a, b, k = name[order], x1[order], x2[order], kind[order]
    fresh = np.concatenate(([True], s[1:] != s[:-1]))
    new = fresh.copy()
    new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(s)))
    least, most = np.repeat(np.minimum.reduceat(lo[order], head), size), np.repeat(np.maximum.reduceat(hi[order], head), size)
    taken[order] = np.repeat(~fresh[head], size)
    answer = np.empty(len(name), np.uint8)
    answer[order] = np.where(least == most, ALONE, np.where(least < lo[order], EARLIER, SHARED))
    answer += taken.astype(np.uint8) * np.uint8(_RENAMED)
    at, out = 0, []
    for blk, r in rows:
        if r[2][0] != WORD:
            out.append((_ANSWER, blk, {"grp": g, "payload": answer[at : at + len(r[0])].tobytes()}))
        at += len(r[0])
    for i in range(0, len(out), 500):
        yield _batch(out[i : i + 500])


def settle(asked: DataFrame, groups: int) -> DataFrame:
    """Names all that the blocks ask for: one task has all that may get one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for blk, g, payload in zip(batch["blk"].to_pylist(), batch["grp"].to_pylist(), batch["payload"], strict=True):
                if g != group:
                    if held:
                        yield from named(group, held)
                    group, held = g, []
                raw = payload.as_py()
                base = np.frombuffer(raw, np.int64, 1)[0]
                x1, x2, kind, lo, more = unpack(raw[8:])
                lo = lo.astype(np.int64) + base
                held.append((blk, [x1, x2, kind, lo, lo + more.astype(np.int64)]))
        if held:
            yield from named(group, held)

    n = min(groups, 4096)
    return asked.select("blk", "grp", "payload").repartitionById(n, F.floor(F.col("grp") * n / groups).cast("int")).sortWithinPartitions("grp").mapInArrow(run, ROWS)


class Words:
    """The words of a block's texts end to end, by both hashes. Texts without an id have none."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], salt: int, both: bool = False):
        mine = [t if i is not None else None for i, t in zip(ids, texts, strict=True)]
        self.name, self.sizes = hash_texts(mine)
        self.other = hash_texts(mine, seed=1)[0] if both or salt else None
        if salt:  # two words had one hash: names come from both
            self.name = mix(self.name + mix(self.other + _U(salt)))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the windows that start there."""
        return window_hashes(self.name, WINDOW)[at], window_hashes(mix(self.other ^ mix(self.name)), WINDOW)[at]


class Sequence:
    """A block's symbols: names, first words and lengths in words, and the span of words
    that each one's making depended on; the windows that are open (by first word), and the
    words that go."""

    def __init__(self, ids, sizes, s, a, n, lo, hi, open_, gone):
        self.ids, self.sizes = np.array([i if i is not None else 0 for i in ids], np.int64), np.asarray(sizes, np.int64)
        self.raw_ids = ids
        self.s, self.a, self.n, self.lo, self.hi, self.open, self.gone = s, a, n, lo, hi, open_, gone
        self.doc_of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @classmethod
    def start(cls, ids, words: Words) -> Sequence:
        sizes, total = words.sizes, len(words.name)
        at = np.arange(total)
        ends = np.repeat(np.cumsum(sizes), sizes)
        return cls(ids, sizes, words.name, at, np.ones(total, np.int64), at, at + 1, at + WINDOW <= ends, np.zeros(total, bool))

    @classmethod
    def load(cls, row: dict) -> Sequence:
        total = sum(row["sizes"])
        bits = lambda c: np.unpackbits(np.frombuffer(row[c], np.uint8), count=total).astype(bool)
        s, a, n, left, right = unpack(row["payload"])
        a, n = a.astype(np.int64), n.astype(np.int64)
        return cls(row["ids"], row["sizes"], s.astype(_U), a, n, a - left, a + n + right, bits("open"), bits("gone"))

    def row(self, blk: int, symbols: bool = True) -> pa.RecordBatch:
        left, right = np.minimum(self.a - self.lo, _FAR), np.minimum(self.hi - self.a - self.n, _FAR)
        return _row(_STATE, blk, payload=pack([x[: len(x) if symbols else 0] for x in (self.s, self.a, self.n, left, right)]), open=np.packbits(self.open).tobytes(), gone=np.packbits(self.gone).tobytes(), ids=self.raw_ids, sizes=self.sizes.tolist())

    def merge(self, number: int) -> tuple[Sequence, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The sequence with this round's runs and pairs as symbols, which of its symbols
        these are, and what each stands for: x1, x2 and kind."""
        s, a, n, k = self.s, self.a, self.n, len(self.s)
        if not k:
            none = np.zeros(0, np.int64)
            return self, none, s, s, none
        doc = self.doc_of[a]
        next_ = np.zeros(k, bool)  # whether symbol i + 1 follows i in the text
        next_[:-1] = (a[:-1] + n[:-1] == a[1:]) & (doc[1:] == doc[:-1])
        equal = next_.copy()
        equal[:-1] &= s[1:] == s[:-1]
        before = np.concatenate(([False], equal[:-1]))
        side = mix(s + _U(2 * number + 3))
        left, right = (side & _ONE).astype(bool), (side & _U(2)).astype(bool)
        pair = next_ & ~equal & ~before & ~left
        pair[:-1] &= left[1:] & ~equal[1:]
        # What has found no partner is dealt to sides once more.
        free = ~(equal | before | pair | np.concatenate(([False], pair[:-1])))
        late = next_ & free & ~right
        late[:-1] &= free[1:] & right[1:]
        join = equal | pair | late
        head = np.flatnonzero(~np.concatenate(([False], join[:-1])))
        count = np.diff(np.append(head, k))
        # Runs and pairs of the first deal depend on a neighbour at each side, those of the
        # second on two, and single symbols on four: that far the spans are joined.
        spans = [(self.lo, self.hi)]
        follows = np.concatenate(([False], next_[:-1]))
        for _ in range(4):
            lo, hi = spans[-1]
            lo = np.minimum(lo, np.where(follows, np.concatenate((lo[:1], lo[:-1])), a - _FAR))
            hi = np.maximum(hi, np.where(next_, np.concatenate((hi[1:], hi[-1:])), a + n + _FAR))
            spans.append((lo, hi))
        (lo, hi), (late_lo, late_hi), (far_lo, far_hi) = spans[1], spans[2], spans[4]
        second = late | np.concatenate(([False], late[:-1]))
        lo, hi = np.where(second, late_lo, lo), np.where(second, late_hi, hi)
        made = count > 1
        new = np.flatnonzero(made)
        new_lo = np.where(made, np.minimum.reduceat(lo, head), far_lo[head])
        new_hi = np.where(made, np.maximum.reduceat(hi, head), far_hi[head])
        run = equal[head[new]]
        x1, x2 = s[head[new]], np.where(run, count[new].astype(_U), s[np.minimum(head[new] + 1, k - 1)])
        kind = np.where(run, RUN, PAIR)
        names = s[head].copy()
        names[new] = name_of(x1, x2, kind)
        out = Sequence(self.raw_ids, self.sizes, names, a[head], np.add.reduceat(n, head), new_lo, new_hi, self.open, self.gone)
        return out, new, x1, x2, kind

    def ask(self, number: int, groups: int) -> Question:
        seq, new, x1, x2, kind = self.merge(number)
        return Question(x1, x2, kind, self.ids[self.doc_of[seq.a[new]]], groups)

    def rewrite(self, number: int, groups: int, found: dict[int, bytes]) -> Sequence:
        """The next sequence, by the answers to ``ask``."""
        seq, new, x1, x2, kind = self.merge(number)
        ids = self.ids[self.doc_of[seq.a[new]]]
        q = Question(x1, x2, kind, ids, groups)
        answer = q.answers(found)[q.of]
        other = answer >= _RENAMED
        seq.s[new[other]] = second_name(x1[other], x2[other], kind[other])
        answer = answer % _RENAMED
        # A window around what only one document has is unique.
        a, n, lo, hi = seq.a[new], seq.n[new], seq.lo[new], seq.hi[new]
        alone = answer == ALONE
        kill = alone & (hi - lo <= WINDOW)
        total = len(self.doc_of)
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, np.maximum(hi[kill] - WINDOW, 0), 1)
        np.add.at(edge, np.minimum(lo[kill] + 1, total), -1)
        open_ = self.open & (np.cumsum(edge[:-1]) == 0)
        # The words of a long symbol that an earlier document has go.
        earlier = ((answer == EARLIER) | ((answer == SHARED) & (ids > q.lo[q.of]))) & (n >= WINDOW)
        reach = np.zeros(total + 1, np.int64)
        np.maximum.at(reach, a[earlier], a[earlier] + n[earlier])
        reach = np.maximum.accumulate(reach)[:total]
        at = np.arange(total)
        seq.gone = self.gone | (reach > at)
        seq.open = open_ & (reach < at + WINDOW)
        # Only what an open window touches, and others have, goes on.
        touched = np.concatenate(([0], np.cumsum(_covered(seq.open))))
        keep = touched[np.minimum(seq.a + seq.n, total)] > touched[seq.a]
        keep[new[alone]] = False
        seq.s, seq.a, seq.n, seq.lo, seq.hi = (x[keep] for x in (seq.s, seq.a, seq.n, seq.lo, seq.hi))
        return seq


def _covered(starts: np.ndarray) -> np.ndarray:
    """Words in the windows that start at the marked words."""
    edge = np.zeros(len(starts) + WINDOW, np.int64)
    edge[: len(starts)] = starts
    edge[WINDOW:] -= starts
    return np.cumsum(edge)[: len(starts)] > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, dict], dict[int, bytes]]]:
    """(block, its text and state rows by kind, answers by group); rows come in order of blocks."""
    blk, rows, found = None, {}, {}
    for batch in batches:
        for i, (b, kind) in enumerate(zip(batch["blk"].to_pylist(), batch["kind"].to_pylist(), strict=True)):
            if b != blk:
                if blk is not None:
                    yield blk, rows, found
                blk, rows, found = b, {}, {}
            if kind == _ANSWER:
                found[batch["grp"][i].as_py()] = batch["payload"][i].as_py()
            else:
                rows[kind] = {c: batch[c][i].as_py() for c in _NAMES[3:]}
    if blk is not None:
        yield blk, rows, found


def _together(*frames: DataFrame) -> DataFrame:
    """All rows of a block in one task, one after another."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.repartition("blk").sortWithinPartitions("blk", "kind")


def _asking(rows: DataFrame, question) -> DataFrame:
    """``question`` of each block (its rows): any number of Question objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blk, mine, _ in _blocks(batches):
            out = [(_ASK, blk, {"grp": g, "payload": p}) for q in question(mine) for g, p in q.payloads()]
            if out:
                yield _batch(out)

    return rows.mapInArrow(run, ROWS)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, rounds: int = 6, block_bytes: int = 4 << 20, group_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text (the
    kept words joined by one space). ``rounds`` is how large symbols may grow; the result
    does not depend on it."""
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        ids, held, size = [], [], 0
        for part in pieces(batches, block_bytes // 4):
            ids += part["id"].to_pylist()
            held += part["text"].to_pylist()
            size += part["text"].nbytes
            if size >= block_bytes:
                yield _row(_TEXT, number, ids=ids, **_packed(held))
                number += 1
                ids, held, size = [], [], 0
        if ids:
            yield _row(_TEXT, number, ids=ids, **_packed(held))

    texts = materialize(source.mapInArrow(block, ROWS), "repeats-texts")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 << (size // group_bytes).bit_length()

    salt = 0
    while True:  # once, unless two words have one hash

        def first(mine: dict, salt: int = salt) -> Iterator[Question]:
            row = mine[_TEXT]
            words = Words(row["ids"], _texts(row), salt, True)
            zero = np.zeros(len(words.name), np.int64)
            if len(zero):
                yield Question(words.name, words.other, zero + WORD, zero, groups)
                yield Sequence.start(row["ids"], words).ask(1, groups)

        answers = materialize(settle(_asking(texts, first), groups), "repeats-names")
        if answers.where(F.col("kind") == _CLASH).isEmpty():
            break
        release(answers)
        salt += 1

    state, number = texts, 1
    while True:

        def rewrite(batches: Iterator[pa.RecordBatch], number: int = number) -> Iterator[pa.RecordBatch]:
            for blk, rows, found in _blocks(batches):
                if _STATE in rows:
                    seq = Sequence.load(rows[_STATE])
                else:
                    seq = Sequence.start(rows[_TEXT]["ids"], Words(rows[_TEXT]["ids"], _texts(rows[_TEXT]), salt))
                yield seq.rewrite(number, groups, found).row(blk, number < rounds)

        old = state
        state = materialize(_together(state, answers).mapInArrow(rewrite, ROWS), f"repeats-{number}", records=16)
        release(answers, *([old] if old is not texts else []))
        number += 1
        if number > rounds:
            break

        def again(mine: dict, number: int = number) -> Iterator[Question]:
            yield Sequence.load(mine[_STATE]).ask(number, groups)

        answers = materialize(settle(_asking(state, again), groups), "repeats-names")
        if answers.isEmpty():
            release(answers)
            break

    def open_windows(rows: dict, texts: list[bytes | None] | None = None) -> tuple[Sequence, np.ndarray, Question]:
        words, seq = Words(rows[_TEXT]["ids"], texts or _texts(rows[_TEXT]), salt, True), Sequence.load(rows[_STATE])
        at = np.flatnonzero(seq.open)
        x1, x2 = words.windows(at) if len(at) else (np.zeros(0, _U), np.zeros(0, _U))
        return seq, at, Question(x1, x2, np.full(len(at), SPAN), seq.ids[seq.doc_of[at]], groups)

    both = _together(texts, state)
    answers = materialize(settle(_asking(both, lambda rows: [open_windows(rows)[2]]), groups), "repeats-windows", records=16)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, found in _blocks(batches):
            raw = _texts(rows[_TEXT])
            seq, at, q = open_windows(rows, raw)
            answer = q.answers(found)[q.of] % _RENAMED
            starts = np.zeros(len(seq.doc_of), bool)
            starts[at] = (answer == EARLIER) | ((answer == SHARED) & (seq.ids[seq.doc_of[at]] > q.lo[q.of]))
            gone = seq.gone | _covered(starts)
            cuts = np.cumsum(np.concatenate(([0], seq.sizes))).tolist()
            n, removed, sha, kept_texts = [], [], [], []
            for i, text in enumerate(raw):
                words = text.split() if text else []
                g = gone[cuts[i] : cuts[i + 1]]
                count = int(g.sum())
                kept = b" ".join(words if not count else [w for w, x in zip(words, g.tolist(), strict=True) if not x])
                n.append(len(words))
                removed.append(count)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            cols = [pa.array(rows[_TEXT]["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept_texts, pa.string())] * with_text, ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    out = materialize(_together(texts, state, answers).mapInArrow(finish, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text), "repeats", records=16)
    release(texts, state, answers)
    return owning(out.withColumnRenamed("id", id_col), out)
