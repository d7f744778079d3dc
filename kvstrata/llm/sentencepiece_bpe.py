"""SentencePiece BPE encoding by backtracking, and decoding.

An encoding is the one sequence of pieces in which each piece, and each pair of
neighbours, comes out unchanged when its text is merged again. The encoder takes the
longest piece that matches (Aho-Corasick gives all pieces at a position), checks that
it goes with the piece before it, and else tries the next shorter; where none fits it
marks the position in a bitfield and steps back. Each position fails at most once, so
the work is linear in the text. Pieces never hold a word mark after another character,
so texts are cut there and cut pieces are kept in a bounded memo.

Defined results: a null text counts as empty; an empty text has no pieces but the begin
and end ids asked for; characters without a piece become byte pieces (or the unknown
id); repeated rows are encoded one by one; an empty table gives no rows; a very long text
is encoded whole, in memory linear in its length; only the id and text columns are read, so
extra columns may have any names.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


def _each_byte(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


codecs.register_error("kvstrata-each-byte", _each_byte)


class _Memo(dict):
    """Encodings of cut pieces of text. A full memo becomes the ``old`` one of the next,
    so frequent pieces stay and size is bounded by two memos."""

    def __init__(self, make, old: dict, most_chars: int):
        super().__init__()
        self.make, self.old, self.most_chars = make, dict(old), most_chars

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.make(part)
        if len(part) <= self.most_chars:
            self[part] = ids
        return ids


class PieceModel:
    """The pieces of a SentencePiece BPE model, with encoder and decoder. The library is
    used to read the model file only."""

    BLOCK, MEMO, MEMO_CHARS, ALONE = 4096, 300_000, 48, (1 << 20) - 1

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        is_byte = [sp.is_byte(i) for i in range(n)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not special[i] and not is_byte[i]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if is_byte[i]}
        self.surface = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if is_byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.longest = max(map(len, self.score))
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, len(p) << 20 | self.ids[p])
        self.automaton.make_automaton()
        self.cut = self._cuts()
        self.pairs: dict[int, bool] = {}
        self.memo = _Memo(self._ids, {}, self.MEMO_CHARS)
        # How this model normalizes, read off two short encodings.
        self.dummy_prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        if sp.encode("  a", out_type=str) == sp.encode("a", out_type=str) or sp.encode("①ﬁ") == sp.encode("1fi"):
            raise ValueError("only models without text normalization are supported")

    def _cuts(self) -> re.Pattern | None:
        """A pattern that cuts texts where no piece can reach across: before word marks
        (if none stands inside a piece), around newlines, and before final punctuation,
        each as far as the pieces allow it."""
        inside = {a + b for p in self.score for a, b in zip(p, p[1:], strict=False)}
        if any(p[1] == MARK != p[0] for p in inside):
            return None
        newline = "" if any("\n" in p for p in inside) else "\n"
        apart = "".join(re.escape(c) for c in ",.!" if not any(p[1] == c and p[0].isalpha() for p in inside))
        body = rf"{MARK}*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{apart}])|" if apart else ""
        return re.compile((rf"{newline}|" if newline else "") + body + rf"{MARK}*[^{MARK}{newline}]+|{MARK}+")

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair again and again (highest
        score, then leftmost)."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether piece ``right`` can follow piece ``left``: merging their text anew
        gives both. With ``left`` -1, whether ``right`` comes out by itself."""
        if len(self.pairs) > 4 * self.MEMO:
            self.pairs.clear()
        parts = [self.pieces[i] for i in (left, right) if i >= 0]
        known = self.pairs[left << 20 | right] = self.merge("".join(parts)) == parts
        return known

    def _matches(self, text: str, start: int) -> list[list[int]]:
        """For each position of the block at ``start``, the pieces that match there,
        shortest first, each as length << 20 | id."""
        size = min(self.BLOCK, len(text) - start)
        found: list[list[int]] = [[] for _ in range(size)]
        if size == len(text):
            for end, code in self.automaton.iter(text):
                found[end + 1 - (code >> 20)].append(code)
        else:
            for end, code in self.automaton.iter(text[start : start + size + self.longest - 1]):
                at = end + 1 - (code >> 20)
                if at < size:
                    found[at].append(code)
        for at, codes in enumerate(found):
            if not codes and text[start + at] not in self.ids:
                codes.append(1 << 20 | self.ALONE)
        return found

    def _ids(self, text: str) -> bytes:
        """The encoding of a text, packed. A character without a piece stands for
        itself (its id is ALONE) and goes with any neighbour."""
        pairs, alone, n, size = self.pairs, self.ALONE, len(text), self.BLOCK
        failed = bytearray(n // 8 + 1)
        codes: list[int] = []
        tried: list[int] = []
        pos = base = 0
        left, k = -1, -1
        found = self._matches(text, 0)
        while pos < n:
            if not 0 <= pos - base < size:
                base = pos - pos % size
                found = self._matches(text, base)
            here = found[pos - base]
            if k < 0:
                k = len(here)
            while k:
                k -= 1
                code = here[k]
                end = pos + (code >> 20)
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                i = code & alone
                if i == alone:
                    i = -1
                else:
                    ok = pairs.get(left << 20 | i)
                    if not ok and (ok is False or not self.fits(left, i)):
                        continue
                codes.append(code)
                tried.append(k)
                pos, left, k = end, i, -1
                break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= codes.pop() >> 20
                k = tried.pop()
                left = codes[-1] & alone if codes else -1
                if left == alone:
                    left = -1
        ids = [c & alone for c in codes]
        if alone in ids:
            flat, at = [], 0
            for c in codes:
                if c & alone != alone:
                    flat.append(c & alone)
                elif self.bytes:
                    flat.extend(self.bytes[b] for b in text[at].encode())
                elif not flat or flat[-1] != self.unk:
                    flat.append(self.unk)
                at += c >> 20
            ids = flat
        return array("I", ids).tobytes()

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        if self.cut is None:
            return self._ids(text)
        if len(self.memo) > self.MEMO:
            self.memo = _Memo(self._ids, self.memo, self.MEMO_CHARS)
        return b"".join(map(self.memo.__getitem__, self.cut.findall(text)))

    def encode(self, text: str | None, bos: bool = False, eos: bool = False) -> list[int]:
        ids = array("I", self.encode_packed(text)).tolist()
        return [self.bos] * bos + ids + [self.eos] * eos

    def _surface(self, ids: list[int]) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids as the library gives it: control ids vanish, bytes that are
        no UTF-8 become one replacement character each, one leading mark goes."""
        ids = list(ids)
        runs = [[]] if not self.control.isdisjoint(ids[1:-1]) else None
        if runs:  # bytes on both sides of a control id make no character together
            for i in ids:
                runs[-1].append(i) if i not in self.control else runs.append([])
            out = b"".join(self._surface(r).decode("utf-8", "kvstrata-each-byte").encode() for r in runs)
        else:
            out = self._surface(ids)
        if self.dummy_prefix and out[:1] == b" ":
            first = next((i for i in ids if i not in self.control), None)
            if first is not None and self.pieces[first].startswith(MARK):
                out = out[1:]
        return out.decode("utf-8", "kvstrata-each-byte")


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, and with
    ``with_ids`` the ids (array<int>), with ``with_text`` the decoded text. Rows are
    independent: no shuffle, memory bounded by one Arrow batch and the memo."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        head, tail = array("I", [m.bos] * bos).tobytes(), array("I", [m.eos] * eos).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
                for text in part["text"]:
                    packed = head + m.encode_packed(text.as_py()) + tail
                    ids = memoryview(packed).cast("I").tolist()
                    decoded = m.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                    if with_text:
                        texts.append(decoded)
                cols = [part["id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    cols.append(pa.array(texts, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
