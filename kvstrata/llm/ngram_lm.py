"""An n-gram language model with interpolated modified Kneser-Ney smoothing.

Counting runs in Spark. Words become 64-bit hashes. Tasks sum the n-grams of about a
million tokens at a time and deal them, as packed arrays, to groups: once by the hash of
the words before the last one (an n-gram's context), and once by that of the words after
the first one. One task then has all n-grams of a context, hence the context's total and
how many words follow it once, twice, more often; and all distinct n-grams that end in an
m-gram, hence the m-gram's continuation count. Each lower order's contexts and continuation
counts come from sums over the order above. m-grams that start a text keep their plain
counts. Groups grow in number with the text, not in size: a task holds one group of about a
million n-grams. A context or ending that a sample of tokens shows to fill a group alone is
dealt by whole n-grams instead, and its sums over the groups are added up.

A group's counts are stored as sorted hash arrays: a directory over the leading bits, 32
further bits of each hash, and a code of one or two bytes for its counts, which stand in a list. Workers map
the files into memory and score whole batches of texts by binary search, so a worker's memory
doesn't grow with the model; from a store that can't be mapped they read one group at a
time, and keep a bounded number of groups.

To bound the shuffle, groups are filled in ``passes``; shuffle files of one pass are gone
before the next.

Defined results: a null text counts as empty (one end token); texts whose id has a
remainder of 0 (of the crc32 of its digits by 10), or no id, are held out; repeated rows
count and are scored each; an empty table gives no rows. With nothing to learn from,
each token has the uniform probability 1. Very long texts are counted and scored whole; a
task holds one text's hashes at a time. Only the id and text columns are read, so extra
columns may have any names.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import dealt, group_of, hash_texts, materialize, mix, open_fs, owning, pack, pieces, release, remove_path, shared_path, unpack

_U = np.uint64
END, BEGIN = _U(0x9AE16A3B2F90404F), _U(0xC949D7C7509E6557)
_CHAIN = _U(0x9E3779B97F4A7C15)
#: Sums of an m-gram: its count, what follows it (all, seen once, twice, more often), plain count.
SUMS = 6
C, TOTAL, RAW = 0, 1, 5


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts end to end, each with its end token, and the starts."""
    words, sizes = hash_texts(texts, lower=True)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(len(words) + len(texts), END, _U)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)] = words
    return out, starts


def places(starts: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def back(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The token k before each one; the begin mark before a text's first."""
    out = np.full(len(h), BEGIN, _U)
    out[k:] = h[: len(h) - k]
    out[at < k] = BEGIN
    return out


def gram_hashes(h: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order the hash of the k tokens up to each one. It counts for tokens
    that have at least k - 2 before them, the begin mark being one more."""
    out = [mix(h + _U(1))]
    for k in range(1, order):
        out.append(mix(out[-1] * _CHAIN + back(h, at, k)))
    return out


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """The same hashes from columns of words in order."""
    out = mix(words[-1] + _U(1))
    for w in words[-2::-1]:
        out = mix(out * _CHAIN + w)
    return out


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of the values are in the sorted array ``few``."""
    if not len(few):
        return np.zeros(len(values), bool)
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


def summed(key: np.ndarray, words: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows in the order of distinct keys, with their sums; of equal keys, the first row's words."""
    if not len(key):
        return key, words, sums
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[head], [w[order[head]] for w in words], [np.add.reduceat(s[order], head) for s in sums]


def distinct(key: np.ndarray, *more: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order with one row's other columns, and the number of rows of each."""
    if not len(key):
        return [key, *more], np.zeros(0, np.int64)
    order = np.argsort(key)
    s = key[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return [s[head], *(m[order[head]] for m in more)], np.diff(np.append(head, len(s)))


# ---------------------------------------------------------------- stored tables


def dump(key: np.ndarray, skip: int, values: list[np.ndarray]) -> bytes:
    """A table of sorted distinct keys (their first ``skip`` bits are alike) and their values:
    a row's code says where its values stand in the list of distinct ones."""
    n = len(key)
    bits = max(0, (n // 12).bit_length())
    bucket, rest = _split(key, skip, bits)
    starts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    code, room = np.zeros(n, np.int64), 1
    for v in values:
        most = int(v.max()) + 1 if n else 1
        if room > (1 << 62) // most:  # number the combinations so far
            code = np.unique(code, return_inverse=True)[1]
            room = int(code.max()) + 1
        code, room = code * most + v, room * most
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    listed = np.stack([v[first] for v in values], 1) if n else np.zeros((0, len(values)))
    width = max(1, np.min_scalar_type(max(0, len(first) - 1)).itemsize)
    parts = [np.array([n, skip, bits, *listed.shape, width], "<i8"), starts.astype("<u4"), rest.astype("<u4"), code.astype(f"<u{width}"), listed.astype("<i8")]
    return b"".join(x.tobytes() for x in parts)


def _split(key: np.ndarray, skip: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = key << _U(skip)
    bucket = (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    return bucket, ((key << _U(bits)) >> _U(32)).astype(np.uint32)


class Table:
    """Reads what ``dump`` wrote from an array of bytes, which may be mapped."""

    def __init__(self, raw: np.ndarray):
        take = lambda at, kind, n: np.frombuffer(raw[at : at + n * np.dtype(kind).itemsize], kind)
        self.n, self.skip, self.bits, m, k, width = take(0, "<i8", 6).tolist()
        at = 48
        self.starts = take(at, "<u4", (1 << self.bits) + 1)
        at += 4 * len(self.starts)
        self.rest = take(at, "<u4", self.n)
        at += 4 * self.n
        self.code = take(at, f"<u{width}", self.n)
        at += width * self.n
        self.listed = take(at, "<i8", k * m).reshape(m, k)
        self.size = at + 8 * k * m

    def get(self, key: np.ndarray) -> np.ndarray:
        """A row of values for each key; zeros for absent ones. Sorted keys are found faster."""
        out = np.zeros((len(key), self.listed.shape[1]), np.int64)
        if not self.n or not len(key):
            return out
        bucket, want = _split(key, self.skip, self.bits)
        lo, hi = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        end = hi.copy()
        for _ in range(int((hi - lo).max()).bit_length()):  # binary search in each bucket
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.rest[np.minimum(mid, self.n - 1)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(less, hi, mid)
        at = np.minimum(lo, self.n - 1)
        hit = np.flatnonzero((lo < end) & (self.rest[at] == want))
        out[hit] = self.listed[self.code[at[hit]]]
        return out


# ---------------------------------------------------------------- counting

ROWS = "kind int, grp bigint, name string, payload binary"
_GRAM, _ENDING, _PARTIAL, _SAMPLE, _FACTS, _FILE, _HOT = range(7)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "grp", "name", "payload"])


def _blocks(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and places of about ``hold`` tokens at a time, whole texts."""
    held, size = [], 0
    for part in pieces(batches):
        h, starts = tokens(part["text"].to_pylist())
        held.append((h, places(starts)))
        size += len(h)
        if size >= hold:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _partial(words: list[np.ndarray], sums: list[np.ndarray], groups: int, kind: int = _PARTIAL) -> Iterator[tuple]:
    """Rows with sums by m-gram, dealt to groups."""
    key, words, sums = summed(key_of(words), words, sums)
    for g, arrays in dealt(group_of(key, groups), [*words, *sums]):
        yield kind, g, None, pack(arrays)


def _zeros(n: int, **sums: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros(n, np.int64) for _ in range(SUMS)]
    for name, value in sums.items():
        out[{"c": C, "total": TOTAL, "raw": RAW}[name]] = value
    return out


def _first_scan(docs: DataFrame, order: int, groups: list[int], rate: float, hold: int) -> DataFrame:
    """Plain counts of words; counts of the m-grams that start texts, for 1 < m < order (the
    name says m); and a sample, at ``rate``, of the m-grams below the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        held, count = np.zeros(0, _U), np.zeros(0, np.int64)

        def plain() -> Iterator[tuple]:
            for k, g, _, p in _partial([held], _zeros(len(held), raw=count, **({"c": count} if order == 1 else {})), groups[1]):
                yield k, g, "1", p

        for h, at in _blocks(batches, hold):
            (w,), n = distinct(h)
            held, _, (count,) = summed(np.concatenate([held, w]), [], [np.concatenate([count, n])])
            out: list[tuple] = []
            if len(held) > 2 * hold:
                out += plain()
                held, count = held[:0], count[:0]
            for m in range(2, order):
                i = np.flatnonzero(at == m - 2)
                if len(i):
                    words = [back(h, at, k)[i] for k in range(m - 1, -1, -1)]
                    out += [(k, g, str(m), p) for k, g, _, p in _partial(words, _zeros(len(i), c=np.ones(len(i), np.int64)), groups[m])]
            if order > 1:
                some = np.flatnonzero(rng.random(len(h)) < rate)
                key = gram_hashes(h, at, order - 1)[-1][some].view(np.int64).tolist()
                key += [int(mix(np.array([BEGIN + _U(1)])).view(np.int64)[0])] * int(rng.binomial((at == 0).sum(), rate)) if order == 2 else []
                out += [(_SAMPLE, k, None, None) for k in key]
            for lo in range(0, len(out), 1000):
                yield _rows(out[lo : lo + 1000])
        last = list(plain())
        for lo in range(0, len(last), 1000):
            yield _rows(last[lo : lo + 1000])

    return docs.mapInArrow(run, ROWS)


def _second_scan(docs: DataFrame, order: int, groups: int, passes: int, number: int, hot: np.ndarray, hold: int) -> DataFrame:
    """n-grams by context with their counts, and by ending, for the groups of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.arange(groups) % passes == number
        for h, at in _blocks(batches, hold):
            grams = gram_hashes(h, at, order)
            g, ending = grams[-1], grams[-2]
            ctx = np.full(len(h), mix(np.array([BEGIN + _U(1)]))[0], _U)
            ctx[1:] = np.where(at[1:] > 0, ending[:-1], ctx[1:])
            full = at >= order - 2
            words = [back(h, at, k) for k in range(order - 2, -1, -1)]
            out = []
            for kind, key in ((_GRAM, ctx), (_ENDING, ending)):
                group = group_of(np.where(among(key, hot), g, key) if len(hot) else key, groups)
                i = np.flatnonzero(full & mine[group])
                (one, j), n = distinct(g[i], i)
                more = [key[j], one, n] if kind == _GRAM else [*(w[j] for w in words), one]
                out += [(kind, b, None, pack(arrays)) for b, arrays in dealt(group[j], more)]
            for lo in range(0, len(out), 200):
                yield _rows(out[lo : lo + 200])

    return docs.mapInArrow(run, ROWS)


def _settle(rows: DataFrame, level: int, top: bool, folder: str, groups: list[int], passes: int, number: int, hot: np.ndarray) -> DataFrame:
    """Sums up the groups of one pass and stores their tables, one file a task. Gives partial
    sums for the level below, those of hot keys, facts, and the files' names: only files of
    tasks that ended well are listed, as each attempt has a name of its own."""
    count, below = groups[level], groups[level - 1] if level > 1 else 0
    parts = _parts(count, passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"n{level}-{number}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        stream, at, index = None, 0, []
        seen = np.zeros((2, 7), np.int64)  # of m-grams and n-grams: counts 1 to 4, how many, sums of c and raw

        def facts(row: int, c: np.ndarray, raw: np.ndarray | None) -> None:
            seen[row, :4] += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
            seen[row, 4:] += ((c > 0).sum(), c.sum(), 0 if raw is None else raw.sum())

        def finish(group: int, held: dict[int, list]) -> Iterator[tuple]:
            nonlocal stream, at
            columns = lambda kind, n: [np.concatenate(x) for x in zip(*held[kind], strict=True)] if kind in held else [np.zeros(0, _U)] * n
            both = columns(_PARTIAL, level + SUMS)
            words, sums = both[:level], [x.astype(np.int64) for x in both[level:]]
            key = key_of(words)
            tables = []
            if top:
                *ends, g = columns(_ENDING, level + 1)
                (g, *ends), _ = distinct(g, *ends)
                ctx, gram, n = columns(_GRAM, 3)
                order = np.argsort(gram)
                gram, ctx, n = gram[order], ctx[order], n[order].astype(np.int64)
                head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
                gram, ctx, n = gram[head], ctx[head], np.add.reduceat(n, head) if len(head) else n
                facts(1, n, None)
                tables = [dump(gram, 0, [n])]
                (known, *ends), c = distinct(key_of(ends), *ends)
                order = np.argsort(ctx)
                ctx, n = ctx[order], n[order]
                head = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
                follow = [np.add.reduceat(x, head) if len(head) else n for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]
                none, zero = np.zeros(len(head), _U), np.zeros(len(head), np.int64)
                # m-grams come before contexts, whose words aren't known here.
                words = [np.concatenate([w, e, none]) for w, e in zip(words, ends, strict=True)]
                sums = [np.concatenate(x) for x in zip(sums, _zeros(len(c), c=c), [zero, *follow, zero], strict=True)]
                key = np.concatenate([key, known, ctx[head]])
            key, words, sums = summed(key, words, sums)
            apart = among(key, hot) if top else np.zeros(len(key), bool)
            if apart.any():
                yield _HOT, 0, None, pack([key[apart], *(w[apart] for w in words), *(s[apart] for s in sums)])
                key, words, sums = key[~apart], [w[~apart] for w in words], [s[~apart] for s in sums]
            facts(0, sums[C], sums[RAW])
            # The keys of a group share their leading bits, but those of the pass's own groups only.
            tables.insert(0, dump(key, count.bit_length() - 1, sums if level == 1 else sums[:RAW]))
            if stream is None:
                stream = fs.open_output_stream(f"{root}/{name}", compression=None)
            for t in tables:
                stream.write(t)
            index.append((group, at))
            at += sum(map(len, tables))
            if level > 1:
                yield from lower(words, sums[C], below)

        def lines() -> Iterator[tuple]:
            group, held = None, {}
            for batch in batches:
                for kind, g, payload in zip(batch["kind"].to_pylist(), batch["grp"].to_pylist(), batch["payload"], strict=True):
                    if g != group:
                        if held:
                            yield from finish(group, held)
                        group, held = g, {}
                    held.setdefault(kind, []).append(unpack(payload.as_buffer()))
            if held:
                yield from finish(group, held)
            if stream is not None:
                table = np.array(index, "<i8")
                stream.write(table.tobytes() + np.array([len(index), at], "<i8").tobytes())
                stream.close()
                yield _FILE, TaskContext.get().partitionId(), name, None
                yield _FACTS, 0, None, pack([seen.reshape(-1)])

        out: list[tuple] = []
        for line in lines():
            out.append(line)
            if len(out) >= 500:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    place = (F.floor(F.col("grp") / passes) * parts / -(-count // passes)).cast("int")
    mine = rows.where(F.col("grp") % passes == number) if passes > 1 else rows
    return mine.select("kind", "grp", "payload").repartitionById(parts, place).sortWithinPartitions("grp").mapInArrow(run, ROWS)


def _parts(groups: int, passes: int) -> int:
    return min(-(-groups // passes), 4096)


def lower(words: list[np.ndarray], c: np.ndarray, groups: int) -> Iterator[tuple]:
    """What m-grams with a count add to the sums of their first and of their last words."""
    some = np.flatnonzero(c)
    if not len(some):
        return
    words, c = [w[some] for w in words], c[some]
    zero = np.zeros(len(c), np.int64)
    first = [zero, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64), zero]
    last = _zeros(len(c), c=np.ones(len(c), np.int64))
    yield from _partial([np.concatenate([a, b]) for a, b in zip(words[:-1], words[1:], strict=True)], [np.concatenate([a, b]) for a, b in zip(first, last, strict=True)], groups)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams have the counts 1 to 4."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5
        out.append(min(max(d, 0.05 * k), 0.95 * k))
    return tuple(out)


# ---------------------------------------------------------------- model


class Model:
    """Reads a model's tables and scores batches of texts. ``files``: by level, name by
    (pass, task)."""

    KEEP = 64  # groups that a worker keeps of a store that can't be mapped

    def __init__(self, folder: str, order: int, groups: list[int], passes: int, files: list[dict[tuple[int, int], str]], rates: list[tuple], total: int, distinct: int, types: int, hot: tuple[np.ndarray, np.ndarray]):
        self.folder, self.order, self.groups, self.passes, self.files = folder, order, groups, passes, files
        self.rates, self.total, self.distinct, self.types, self.hot = rates, total, distinct, types, hot
        self.open: dict = {}
        self.near: OrderedDict = OrderedDict()

    def _file(self, level: int, group: int):
        """(reader, where the group starts and ends), or none."""
        count, passes = self.groups[level], self.passes if level == max(1, self.order - 1) else 1
        name = self.files[level].get((group % passes, group // passes * _parts(count, passes) // -(-count // passes)))
        if name is None:
            return None
        if name not in self.open:
            fs, path = open_fs(f"{self.folder}/{name}")
            if fs.type_name == "local":
                raw = np.memmap(path, "u1", "r")
                read = lambda a, b: raw[a:b]
                size = len(raw)
            else:
                src = fs.open_input_file(path)
                read, size = lambda a, b: np.frombuffer(src.read_at(b - a, a), "u1"), src.size()
            n, end = read(size - 16, size).view("<i8").tolist()
            index = read(end, end + 16 * n).view("<i8").reshape(n, 2)
            self.open[name] = (fs.type_name == "local", read, index[:, 0].copy(), np.append(index[:, 1], end))
        local, read, groups, starts = self.open[name]
        i = int(np.searchsorted(groups, group))
        return (local, read, int(starts[i]), int(starts[i + 1])) if i < len(groups) and groups[i] == group else None

    def tables(self, level: int, group: int) -> list[Table]:
        key = (level, group)
        if key not in self.near:
            found = self._file(level, group)
            out: list[Table] = []
            if found:
                local, read, a, b = found
                raw = read(a, b)
                while raw.size:
                    out.append(Table(raw))
                    raw = raw[out[-1].size :]
            self.near[key] = out
            if found and not local and len(self.near) > self.KEEP:
                self.near.popitem(last=False)
        return self.near[key]

    def _get(self, level: int, which: int, by: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
        """Values of keys in the ``which``-th tables of the groups of ``by``."""
        out = np.zeros((len(key), width), np.int64)
        order = np.argsort(by)
        group = group_of(by[order], self.groups[level])
        cut = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])) if len(group) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            tables = self.tables(level, int(group[a]))
            if tables:
                mine = order[a:b]
                if by is not key:
                    mine = mine[np.argsort(key[mine])]
                out[mine] = tables[which].get(key[mine])
        return out

    def sums(self, level: int, key: np.ndarray) -> np.ndarray:
        """The sums of m-grams."""
        out = self._get(level, 0, key, key, SUMS if level == 1 else RAW)
        keys, values = self.hot
        if level == self.order - 1 and len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            out[hit] = values[: out.shape[1], at[hit]].T
        return out

    def counts(self, ctx: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Plain counts of n-grams."""
        return self._get(self.order - 1, 1, np.where(among(ctx, self.hot[0]), g, ctx), g, 1)[:, 0]

    @staticmethod
    def _cut(count: np.ndarray, rate: tuple) -> np.ndarray:
        return np.maximum(count - np.array([0.0, *rate])[np.minimum(count, 3)], 0.0)

    def score(self, texts: list[bytes | None]) -> tuple[list, list, list, list]:
        """By text: tokens, known tokens, base score and log10 probability."""
        h, starts = tokens(texts)
        at = places(starts)
        grams = gram_hashes(h, at, self.order)
        begin = mix(np.array([BEGIN + _U(1)]))
        u, inverse = np.unique(np.append(grams[0], begin), return_inverse=True)
        before = self.sums(1, u)[inverse]  # the begin mark's come last
        count, raw = before[:-1, C], before[:-1, RAW]
        base = np.log10((raw + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        d = self.rates[1]
        if self.types:
            rest = (d[0] * d[3] + d[1] * d[4] + d[2] * d[5]) / self.types
            p = self._cut(count, d[:3]) / self.types + rest / (self.distinct + 1)
        else:
            p = np.full(len(h), 1.0 / (self.distinct + 1))
        for level in range(2, self.order + 1):
            i = np.flatnonzero(at >= level - 2)
            stats = before[np.where(at[i] > 0, i - 1, len(h))]
            if level < self.order:
                before = np.zeros((len(h), RAW), np.int64)
                before[i] = self.sums(level, grams[level - 1][i])
                c = before[i, C]
            else:
                ctx = np.where(at[i] > 0, grams[level - 2][i - 1], begin[0])
                c = self.counts(ctx, grams[level - 1][i])
            known = np.flatnonzero(stats[:, TOTAL])
            i, c, stats = i[known], c[known], stats[known]
            d = self.rates[level]
            p[i] = (self._cut(c, d[:3]) + (stats[:, 2:5] @ np.array(d[:3])) * p[i]) / stats[:, TOTAL]
        score = np.log10(p)
        sums = lambda x: np.add.reduceat(x, starts[:-1]).tolist() if len(starts) > 1 else []
        return np.diff(starts).tolist(), sums((raw > 0).astype(np.int64)), sums(base), sums(score)


def _collect(df: DataFrame, seen: np.ndarray, files: dict, number: int) -> None:
    """Facts and file names of one job: two rows a task."""
    for r in df.where(F.col("kind").isin(_FACTS, _FILE)).select("kind", "grp", "name", "payload").collect():
        if r["kind"] == _FACTS:
            seen += unpack(r["payload"])[0].astype(np.int64).reshape(2, 7)
        else:
            files[number, r["grp"]] = r["name"]


def train(docs: DataFrame, *, text_col: str = "text", order: int = 3, passes: int = 6, group_tokens: int = 1 << 20, hold: int = 1 << 19) -> Model:
    """Counts and writes a model from all rows of ``docs``, in a fresh folder of the shared
    store. Names of files, sums over all n-grams and sums of hot keys, of which there are
    fewer than groups, come to the driver."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    folder = shared_path(spark, "ngrams")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = 1 << max(0, (size // 6 // group_tokens).bit_length())  # six bytes a token or so
    last = max(1, order - 1)
    groups = [1, min(many, 4096)] + [many] * (order - 2) if order > 2 else [1, many]
    passes = min(passes, groups[last]) if order > 1 else 1
    files: list[dict] = [{} for _ in range(last + 1)]
    rates: list[tuple] = [()] * (order + 1)
    empty = np.zeros(0, _U)

    first = materialize(_first_scan(source, order, groups, min(1.0, 100 / group_tokens), hold), "ngrams-first")
    # A key that may fill a group alone has about a hundred samples.
    sample = first.where(F.col("kind") == _SAMPLE).groupBy("grp").agg(F.count("*").alias("n")).where("n >= 50").select("grp").collect()
    hot = np.sort(np.array([r[0] for r in sample], np.int64).view(_U)) if sample else empty
    table = (hot, np.zeros((SUMS, len(hot)), np.int64))

    seen = np.zeros((2, 7), np.int64)
    done: list[DataFrame] = []
    down: list[DataFrame] = []
    for level in range(last, 0, -1):
        top = order > 1 and level == last
        start = first.where((F.col("kind") == _PARTIAL) & (F.col("name") == str(level))).select("kind", "grp", "name", "payload")
        seen = np.zeros((2, 7), np.int64)
        now = []
        for number in range(passes if top else 1):
            rows = start
            for p in [_second_scan(source, order, many, passes, number, hot, hold)] if top else [*down, *(x.where(F.col("kind") == _PARTIAL) for x in done)]:
                rows = rows.unionByName(p)
            now.append(materialize(_settle(rows, level, top, folder, groups, passes if top else 1, number, hot), f"ngrams-{level}"))
            _collect(now[-1], seen, files[level], number)
        release(*done)
        done, down = now, []
        if top:
            rates[order] = discounts(seen[1, :4].tolist())
            if len(hot):
                words, values = _hot_sums(now, level, hot)
                table = (hot, values)
                c = values[C]
                seen[0, :4] += np.bincount(np.minimum(c, 5), minlength=6)[1:5]
                seen[0, 4:] += ((c > 0).sum(), c.sum(), values[RAW].sum())
                if level > 1:
                    down = [spark.createDataFrame([(k, g, n, bytearray(p)) for k, g, n, p in lower(words, c, groups[level - 1])], ROWS)]
        rates[level] = discounts(seen[0, :4].tolist())
    one, two, *_ = seen[0].tolist()
    distinct_, types, total = seen[0, 4:].tolist()
    rates[1] = (*rates[1], one, two, distinct_ - one - two)
    release(first, *done)
    return Model(folder, order, groups, passes, files, rates, total, distinct_, types, table)


def _hot_sums(jobs: list[DataFrame], level: int, hot: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Words and sums of the hot keys over all groups, in the order of the keys."""
    words, values = [np.zeros(len(hot), _U) for _ in range(level)], np.zeros((SUMS, len(hot)), np.int64)
    for df in jobs:
        for r in df.where(F.col("kind") == _HOT).select("payload").toLocalIterator():
            key, *more = unpack(r["payload"])
            at = np.searchsorted(hot, key)
            for w, x in zip(words, more[:level], strict=True):
                w[at] = np.maximum(w[at], x)  # rows of contexts have no words: zeros
            for v, x in zip(values, more[level:], strict=True):
                v[at] += x.astype(np.int64)
    return words, values


_MODELS: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score and score (log10 probability)."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    state = {k: v for k, v in vars(model).items() if k not in ("open", "near")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if state["folder"] not in _MODELS:
            _MODELS.clear()
            _MODELS[state["folder"]] = Model(**state)
        m = _MODELS[state["folder"]]
        for part in pieces(batches, 2 << 20):
            n, known, base, value = m.score(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64())], ["id", "n_tokens", "n_known", "base_score", "score"])

    return source.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("id", id_col)


def split_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **model) -> DataFrame:
    """Learns from the documents that aren't held out, and scores all: id, held_out,
    n_tokens, n_known, train_tokens, base_score, score."""
    held = F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    made = train(docs.where(~held), text_col=text_col, **model)
    out = materialize(score(docs, made, id_col=id_col, text_col=text_col), "scores")
    remove_path(docs.sparkSession, made.folder)
    return owning(out.select(id_col, held.alias("held_out"), "n_tokens", "n_known", F.lit(made.total).cast("bigint").alias("train_tokens"), "base_score", "score"), out)
