"""Packing: documents into token sequences by cutting-stock column generation.

A document's ids fill whole sequences of their own, and what is left over, its
tail, shares one. Which tails share is a cutting-stock problem on the histogram
of tail lengths: a linear program chooses how often each pattern (a set of
lengths that fits a sequence) is used, and new patterns are priced by a
knapsack over the lengths' dual values. The rounded patterns are dealt out to
the tails by rank within their length, which is arithmetic on a bounded table.
Room that a pattern leaves, and tails that rounding leaves, meet on one line of
tokens that is cut to fill the room exactly, so no sequence is padded.
"""

from __future__ import annotations

import hashlib
import json
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgraph.llm.common import rows_of, stored
from corpusgraph.session import broadcast_if_small

#: Words, and characters of words, that a worker remembers before it starts anew.
WORDS, WORD_BYTES = 400_000, 16_000_000
#: Bytes of text that are tokenized at a time.
TEXT_BYTES = 4_000_000
#: ASCII marks that end a word after a Latin letter or a digit are tokens of their own; an apostrophe may not be.
MARKS, LATIN = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "\u0250"
#: Bytes of a text: ASCII white space, marks, letters and digits, all others.
BLANK, MARK, ENDS, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
for kind, characters in ((BLANK, " \t\n\x0b\x0c\r"), (MARK, MARKS), (ENDS, string.ascii_letters + string.digits)):
    KINDS[list(characters.encode())] = kind
#: Classes of tail lengths in the linear program, and the share of its lower bound that it may miss.
CLASSES, GAP = 128, 0.001
RESULT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words(dict):
    """Word to the little-endian ids of the tokenizer, kept for words that come again.

    The tokenizers in use never let a token reach across ASCII white space, so
    a text's ids are its words' ids in a row; ``separable`` tells whether that
    holds for the file at hand. Words of many texts are told apart and their
    ids laid out by array operations; Python meets each different word once.
    """

    loaded: dict[str, Words] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.encoder, self.held = Tokenizer.from_str(spec), 0
        mark = json.loads(spec)["model"].get("end_of_word_suffix")
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        #: Whether an id ends a word; empty where the file has no mark for that.
        self.last = np.zeros(max(vocabulary.values(), default=-1) + 1 if mark else 0, bool)
        if mark:
            self.last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.added = tuple(t.content for t in self.encoder.get_added_tokens_decoder().values())
        self.apart = separable(self.encoder)

    @classmethod
    def of(cls, spec: str) -> Words:
        """One per worker and file."""
        name = hashlib.sha256(spec.encode()).hexdigest()
        if name not in cls.loaded:
            cls.loaded = {name: cls(spec)}
        return cls.loaded[name]

    @staticmethod
    def ends_a_token(base: str) -> bool:
        last = base[-1]
        # Lower-casing may leave a combining mark behind a letter, which a mark would join.
        return last.lower().isalpha() and last < LATIN or last in "0123456789"

    def plain(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of ``words``; marks at a word's end are told apart, which makes the words fewer."""
        marked = []
        for w in words:
            base = w.rstrip(MARKS)
            if base and len(base) < len(w) and self.ends_a_token(base) and not any(t in w for t in self.added):
                marked.append((w, base, w[len(base) :]))
        new = set(words).difference(w for w, _, _ in marked)
        new.update(x for _, *parts in marked for x in parts if x not in self)
        letters = [w for w in new if w.isalpha()]
        if letters and len(self.last):
            # In one text, where a word of one run of letters ends with a token that says so.
            ids = np.array(self.encoder.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(letters):  # a word of more runs would have ended more than once
                self.cut(letters, ids, ends)
                new.difference_update(letters)
        if new:
            rest = list(new)
            told = self.encoder.encode(rest, is_pretokenized=True, add_special_tokens=False)
            if None in told.word_ids:
                self.update(zip(rest, map(self.plain, rest)))
            else:
                self.cut(rest, np.array(told.ids, "<u4"), np.cumsum(np.bincount(np.array(told.word_ids, np.int64), minlength=len(rest))))
        self.update((w, self[base] + self[tail]) for w, base, tail in marked)

    def cut(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, stop = ids.tobytes(), (4 * ends).tolist()
        self.update(zip(words, (data[a:b] for a, b in zip([0, *stop], stop))))

    def unmarked(self, texts: pa.Array) -> pa.Array:
        """``texts`` with a blank before the marks that end a word after an ASCII letter or digit, as ``learn`` tells them apart.

        Then words with and without a mark are one word to look up. Texts stay as they are if an added token is among them.
        """
        texts = texts.cast(pa.large_string())
        _, starts, data = texts.buffers()
        offsets = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return texts
        data = data[int(offsets[0]) : int(offsets[-1])]
        offsets = offsets - offsets[0]
        if any(t.encode() in data.to_pybytes() for t in self.added):
            return texts
        kind = KINDS[np.frombuffer(data, np.uint8)]
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[0], before[1:], after[-1], after[:-1] = BLANK, kind[:-1], BLANK, kind[1:]
        edges = offsets[(offsets > 0) & (offsets < len(kind))]  # a text's edge is a blank to its neighbour
        before[edges], after[edges - 1] = BLANK, BLANK
        mark = kind == MARK
        # Runs of marks: where they begin and how they end.
        first, last = np.flatnonzero(mark & (before != MARK)), np.flatnonzero(mark & (after != MARK))
        cut = first[(before[first] == ENDS) & (after[last] == BLANK)]
        out = np.insert(np.frombuffer(data, np.uint8), cut, 32)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(cut, offsets)), pa.py_buffer(out))

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text, four bytes each."""
        if not self.apart:
            return [self.plain(t) for t in texts.to_pylist()]
        parts = pc.ascii_split_whitespace(self.unmarked(texts))
        every = parts.flatten().dictionary_encode()
        words = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, words))
        if None in found:
            new = [w for w, v in zip(words, found) if v is None]
            self.held += sum(map(len, new))
            if len(self) > WORDS or self.held > WORD_BYTES:
                again = {w: v for w, v in zip(words, found) if v is not None}
                self.clear()
                self.update(again)  # no word is learnt twice for the same texts
                self.held = sum(map(len, words))
            self.learn(new)
            found = list(map(self.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        known, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        at = every.indices.to_numpy()
        ends = np.cumsum(size[at])
        out = known[np.repeat(start[at] - (ends - size[at]), size[at]) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stop = (4 * np.concatenate(([0], ends))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]).tolist()
        return [out[a:b] for a, b in zip(stop, stop[1:])]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    place = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def separable(encoder) -> bool:
    """True if white space ends a token and leaves none: seen on a text with every kind of it."""
    words = ["one", "Two", ",", "it's", "3", ".", "été", "<|endoftext|>", "ab", "?"]
    for blank in (" ", "\n", "\t", "\r", "\x0b", "\x0c", " \n\t "):
        apart = [i for w in words for i in encoder.encode(w, add_special_tokens=False).ids]
        if encoder.encode(blank + blank.join(words) + blank, add_special_tokens=False).ids != apart:
            return False
    glued = [encoder.encode(t, add_special_tokens=False).ids for t in ("one, two*** 3; 4:- a! é. b?&%\n", "one , two *** 3 ; 4 :- a ! é . b ?&%\n")]
    return glued[0] == glued[1]


# The linear program


def priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within every capacity, and the length it takes last (0: none).

    ``value[l]`` is the worth of a piece of ``l`` tokens.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    length = np.flatnonzero(value > 0)
    worth = value[length]
    upto = np.searchsorted(length, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := upto[room]:
            sums = worth[:n] + best[room - length[:n]]
            at = sums.argmax()
            if sums[at] > best[room]:
                best[room], last[room] = sums[at], length[at]
    return best, last


def pattern(last: np.ndarray, room: int) -> Counter:
    """The lengths that the knapsack puts into ``room``."""
    found: Counter = Counter()
    while room > 0:
        if last[room]:
            found[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return found


def generate(demand: dict[int, int], capacity: int, gap: float = GAP) -> tuple[list[Counter], np.ndarray, np.ndarray]:
    """Patterns, how often each is used, and the lengths' dual values.

    Solves ``min sum(x)`` subject to ``sum(x_j * pattern_j[l]) = demand[l]`` by
    the revised simplex method from patterns of one length each. A knapsack
    over the duals gives for every length its best pattern at once; they enter
    one after the other while they still gain. Ends when the objective lies
    within ``gap`` of its lower bound: the tokens over the capacity, or the
    objective over the best pattern's worth.
    """
    lengths = sorted(demand)
    row = {n: i for i, n in enumerate(lengths)}
    size = np.array(lengths)
    columns = [Counter({n: capacity // n}) for n in lengths]
    inverse = np.diag(1.0 / (capacity // size))
    x = inverse @ np.array([demand[n] for n in lengths], float)
    volume = float(sum(n * k for n, k in demand.items())) / capacity
    while True:
        dual = inverse.sum(axis=0)
        value = np.zeros(capacity + 1)
        value[size] = dual
        best, last = priced(value, capacity)
        most = best[capacity]
        if most <= 1 + 1e-9 or x.sum() <= (1 + gap) * max(volume, x.sum() / most):
            return columns, x, dual
        # The most worthy pattern with each length, the best ones first.
        reach = dual + best[capacity - size]
        entered = 0
        for i in np.argsort(-reach, kind="stable"):
            if reach[i] <= 1 + 1e-7:
                break
            column = pattern(last, capacity - lengths[i])
            column[lengths[i]] += 1
            at = np.array([row[n] for n in column])
            times = np.array(list(column.values()), float)
            if times @ dual[at] <= 1 + 1e-9:
                continue
            step = inverse[:, at] @ times
            up = np.flatnonzero(step > 1e-9)
            if not len(up):
                continue
            ratio = x[up] / step[up]
            out = up[ratio.argmin()]
            theta = x[out] / step[out]
            x = np.maximum(x - theta * step, 0)
            x[out] = theta
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
            dual = dual + (1 - step.sum()) * pivot
            columns[out] = column
            entered += 1
        if not entered:
            return columns, x, dual


# The plan


@dataclass
class Plan:
    """Where the piece of a length and rank goes; a few numbers per pattern and length.

    ``blocks``: rows (length, first rank, pieces of it a sequence, first
    sequence, offset there), by length and rank; ``line[length]``: first rank
    that lies on the line and the place of its first token. ``segments``: rows
    (place on the line, size, first sequence, offset there) of runs of equal
    pieces of the line.
    """

    capacity: int
    blocks: np.ndarray = field(default_factory=lambda: np.empty((0, 5), np.int64))
    line: dict[int, tuple[int, int]] = field(default_factory=dict)
    segments: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))


def rounded(columns: list[Counter], x: np.ndarray, demand: dict[int, int]) -> list[tuple[Counter, int]]:
    """Whole numbers of patterns that demand can fill."""
    rest, used = dict(demand), Counter()
    for up in (0, 1):  # first the whole parts, then what still fits of the rounded-up ones
        for j in np.argsort(-(x % 1), kind="stable"):
            most = min(rest[n] // k for n, k in columns[j].items())
            times = min(most, up if up else int(x[j] + 1e-6))
            if times > 0:
                used[j] += times
                for n, k in columns[j].items():
                    rest[n] -= k * times
    return [(columns[j], t) for j, t in sorted(used.items())]


def runs(chosen: list[tuple[Counter, int]], queues: dict[int, list[list[int]]]) -> list[tuple[Counter, int]]:
    """Patterns of classes as patterns of lengths.

    A class deals out its pieces in the order of ``queues``, rows (length,
    pieces), which are used up: every place of a pattern takes the next ones
    for all its sequences. So the lengths in a place change seldom, and a
    pattern falls into few runs of sequences alike.
    """
    out = []
    for p, times in chosen:
        places = []
        for c, copies in p.items():
            for _ in range(copies):
                want, got = times, []
                while want:
                    length, n = queues[c][-1]
                    n = min(n, want)
                    got.append([length, n])
                    want -= n
                    queues[c][-1][1] -= n
                    if not queues[c][-1][1]:
                        queues[c].pop()
                places.append(got[::-1])
        while times:
            n = min(got[-1][1] for got in places)
            out.append((Counter(got[-1][0] for got in places), n))
            times -= n
            for got in places:
                got[-1][1] -= n
                if not got[-1][1]:
                    got.pop()
    return out


def plan(demand: dict[int, int], wholes: int, capacity: int, gap: float = GAP, classes: int = CLASSES) -> Plan:
    """Places for ``demand[length]`` pieces of every length below ``capacity``, after ``wholes`` full sequences."""
    if not demand:
        return Plan(capacity)
    grain = -(-capacity // classes)
    queues: dict[int, list[list[int]]] = {}
    for n in sorted(demand):
        queues.setdefault(-(-n // grain), []).append([n, demand[n]])
    queues = {q[-1][0]: q for q in queues.values()}  # a class is as long as its longest piece
    by_class = {c: sum(k for _, k in q) for c, q in queues.items()}
    chosen = runs(rounded(*generate(by_class, capacity, gap)[:2], by_class), queues)
    rest = Counter({n: k for q in queues.values() for n, k in q})
    room = lambda p: capacity - sum(n * k for n, k in p.items())
    # As long as the line is too short for the room, the patterns that leave most of it go onto the line.
    chosen.sort(key=lambda c: room(c[0]))
    short = sum(room(p) * t for p, t in chosen) - sum(n * k for n, k in rest.items())
    while short > 0:
        p, times = chosen.pop()
        gone = min(times, -(-short // capacity))
        for n, k in p.items():
            rest[n] += k * gone
        if times > gone:
            chosen.append((p, times - gone))
        short -= gone * capacity
    blocks, segments, rank, sequence, place = [], [], Counter(), wholes, 0
    for p, times in reversed(chosen):
        at = 0
        for n in sorted(p, reverse=True):
            blocks.append((n, rank[n], p[n], sequence, at))
            rank[n] += p[n] * times
            at += n * p[n]
        if at < capacity:
            segments.append((place, capacity - at, sequence, at))
            place += (capacity - at) * times
        sequence += times
    tokens = sum(n * k for n, k in rest.items())
    fulls, over = divmod(tokens - place, capacity)
    if fulls:
        segments.append((place, capacity, sequence, 0))
        place, sequence = place + fulls * capacity, sequence + fulls
    for bit in range(over.bit_length() - 1, -1, -1):  # powers of two need no padding
        if over >> bit & 1:
            segments.append((place, 1 << bit, sequence, 0))
            place, sequence = place + (1 << bit), sequence + 1
    ordered = sorted((n for n in rest if rest[n]), reverse=True)
    starts = [0, *accumulate(n * rest[n] for n in ordered)]
    lined = {n: (rank[n], at) for n, at in zip(ordered, starts)}
    return Plan(capacity, np.array(sorted(blocks), np.int64).reshape(-1, 5), lined, np.array(segments, np.int64).reshape(-1, 4))


def places(p: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """``(start, length, sequence, offset)`` of the pieces of one tail."""
    if length in p.line and rank >= p.line[length][0]:
        first, at = p.line[length]
        at += (rank - first) * length
        end, done, out = at + length, 0, []
        while at < end:
            start, size, sequence, offset = p.segments[np.searchsorted(p.segments[:, 0], at, side="right") - 1].tolist()
            number, within = divmod(at - start, size)
            n = min(end - at, size - within)
            out.append((done, n, sequence + number, offset + within))
            at, done = at + n, done + n
        return out
    low = np.searchsorted(p.blocks[:, 0], length)
    high = np.searchsorted(p.blocks[:, 0], length, side="right")
    _, first, many, sequence, offset = p.blocks[low + np.searchsorted(p.blocks[low:high, 1], rank, side="right") - 1].tolist()
    number, copy = divmod(rank - first, many)
    return [(0, length, sequence + number, offset + copy * length)]


# The jobs


def tokenized(docs: DataFrame, spec: str, capacity: int, end: int, key: str, text: str) -> DataFrame:
    """Per document a row of its full pieces, if any, and one of its tail, if any.

    ``part, length, nth``: the ``nth`` tail of this length in its task, or for
    full pieces (length ``capacity``) the number of those before it;
    ``start, crcs``: checksums of the pieces from there on; ``ids``: the tail's.
    """
    kind = dict(docs.select(F.col(key).alias("doc_id")).dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file, a few megabytes
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "part", "length", "nth", "doc_tokens", "start", "crcs", "ids"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen, wide = Words.of(held.value), TaskContext.get().partitionId(), Counter(), 4 * capacity
        for batch in batches:
            for b in by_bytes(batch, "text"):
                rows, take = [], []
                for i, ids in enumerate(words.ids(pc.fill_null(b.column("text"), ""))):
                    ids += last
                    tokens, fulls = len(ids) // 4, len(ids) // wide
                    if fulls:
                        rows.append((part, capacity, seen[capacity], tokens, 0, [zlib.crc32(ids[k * wide : (k + 1) * wide]) for k in range(fulls)], None))
                        seen[capacity] += fulls
                        take.append(i)
                    if tail := ids[fulls * wide :]:
                        n = len(tail) // 4
                        rows.append((part, n, seen[n], tokens, fulls * capacity, [zlib.crc32(tail)], tail))
                        seen[n] += 1
                        take.append(i)
                cols = list(zip(*rows))
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        tell, f"doc_id {kind}, part int, length int, nth long, doc_tokens long, start long, crcs array<long>, ids binary"
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, gap: float = GAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row per piece.

    ``tokenizer`` is the path of a tokenizer file that the driver can read. A
    document's ids are the text's (null: empty) without special tokens added,
    then ``end``. Every id lies in one piece; a sequence has ``capacity`` ids,
    but for the last few, whose sizes are powers of two; so nothing is padded.
    Rows are packed each, whether or not their key is null or repeats; other
    columns are ignored; an empty table gives an empty result.

    The histogram has a row per length below ``capacity`` and the plan a row
    per pattern and length: what goes through the driver does not grow with
    the documents. Ranks come from counts per task and length.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    units = stored(tokenized(docs, spec, capacity, end, key, text), "tokens")
    counts = stored(units.groupBy("part", "length").agg(F.sum(F.size("crcs")).alias("n")), "lengths")
    demand = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    wholes = demand.pop(capacity, 0)
    held = spark.sparkContext.broadcast(plan(demand, wholes, capacity, gap))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = units.join(broadcast_if_small(first), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in rows_of(batch, 1024):
                take, rows = [], []
                columns = (b.column(c).to_pylist() for c in ("length", "rank", "doc_tokens", "start", "crcs", "ids"))
                for i, (length, rank, tokens, start, crcs, ids) in enumerate(zip(*columns)):
                    if ids is None:
                        rows += [(start + k * capacity, capacity, crc, tokens, rank + k, 0) for k, crc in enumerate(crcs)]
                        take += [i] * len(crcs)
                        continue
                    found = places(held.value, length, rank)
                    for at, n, sequence, offset in found:
                        crc = crcs[0] if n == length else zlib.crc32(ids[4 * at : 4 * (at + n)])
                        rows.append((start + at, n, crc, tokens, sequence, offset))
                    take += [i] * len(found)
                cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(take, pa.int64())), *cols], names=["doc_id", *(f.split()[0] for f in RESULT.split(", "))])

    return ranked.mapInArrow(put, f"doc_id {dict(units.dtypes)['doc_id']}, {RESULT}")
