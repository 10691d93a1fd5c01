"""Best-fit packing with swap-based local search.

Documents become token ids; only those longer than a sequence are cut. Packing
depends on lengths alone, so the corpus is reduced to a histogram of piece
lengths (at most ``capacity`` counts, whatever its size). A first packing by
best fit in no particular order is improved by local search: one-for-one and
two-for-one exchanges and moves between underfull bins raise the squared fill
until bins empty. Where no exchange is left, the underfull bins and as many full
ones are dealt anew and the search goes on. All of this works on groups of equal
bins with a multiplicity; the resulting plan places the r-th piece of each
length, and pieces get their rank by a distributed two-level count.

Defined results: null text is empty and gives its end token only; repeated
rows are packed each; an empty table gives an empty result; null ids stay null;
other columns are not read.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import local_table, maybe_broadcast, written
from marlstone.llm.tokens import text_slices

CAPACITY = 2048
END = b"\0\0\0\0"
#: Words from which on a worker starts a new generation of its memory; there are two generations.
MEMO_WORDS = 500_000
#: Words that one call of the library gets.
WORDS_AT_ONCE = 500
#: Pieces of one length for which one bucket for ranking is made.
ROWS_PER_BUCKET = 50_000
#: Times that underfull bins are dealt anew without fewer bins before the search ends.
PATIENCE, WORSE = 10, 5
_BORDER = re.compile("(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])[.,!#$%&*;:?)(]")


@cache
def _tokenizer(path: str | None):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


def spaced(text: str) -> str:
    """A text with the same ids but fewer distinct words.

    Closing punctuation never joins a Latin letter or digit before it, so a space
    goes between them. Latin-1 texts without special tokens have nothing to
    compose, and their letters change case one by one, so they are lower-cased.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return _BORDER.sub(r" \g<0>", text)


class WordEncoder:
    """Ids of texts by the library, each distinct word once.

    The vocabulary drops white space, no piece of it crosses white space, and
    neither normalisation nor composition reaches over a space. So a text's ids
    are those of its words, one after the other. Words that are new to the memory
    go to the library many at a time, with a word of one id between them; words
    that hold this mark go alone.
    """

    MARK = "\x01"

    def __init__(self, path: str | None = None):
        self.tokenizer = _tokenizer(path)
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        (self.mark,) = self._library(self.MARK)

    def _library(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _encode(self, words: list[bytes]) -> None:
        mark = self.MARK.encode()
        plain = [w for w in words if mark not in w]
        for k in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[k : k + WORDS_AT_ONCE]
            ids = self._library(f" {self.MARK} ".join(w.decode() for w in some))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(some):
                raise RuntimeError("the vocabulary does not keep words apart")
            raw = ids.tobytes()
            for w, a, b in zip(some, [0, *(4 * ends[:-1] + 4).tolist()], (4 * ends).tolist(), strict=True):
                self.memo[w] = raw[a:b]
        for w in words:
            if mark in w:
                self.memo[w] = self._library(w.decode()).tobytes()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        words = [spaced(text.decode()).encode().split() for text in texts]
        new = set().union(*words).difference(self.memo)
        known = [w for w in new if w in self.old]
        self.memo.update((w, self.old[w]) for w in known)
        self._encode(list(new.difference(known)))
        of = self.memo.__getitem__
        for some in words:
            yield b"".join(map(of, some))


@cache
def _encoder(path: str | None) -> WordEncoder:
    """A worker's encoder, whose words stay known from one of its tasks to the next."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` of every document's ids and end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for first, stop, data, at in text_slices(batch.column(1), 1 << 20):
                texts = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                for r, packed in zip(range(first, stop), encoder.ids(texts), strict=True):
                    packed += END
                    for p, a in enumerate(range(0, len(packed), 4 * capacity)):
                        part = packed[a : a + 4 * capacity]
                        row.append(r)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
            columns = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class BinGroups:
    """Groups of equal bins: ``items`` (tuple of lengths, descending) -> how many such bins there are."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, Counter()
        #: Underfull groups, the emptiest first, and by their room.
        self.underfull: list[tuple[int, tuple[int, ...]]] = []
        self.by_room: dict[int, list[tuple[int, ...]]] = {}
        self.rooms: list[int] = []
        #: When an underfull group of each room last came or grew.
        self.clock, self.came = 0, {}
        #: The rooms of the latest of them, in time order.
        self.late: deque[int] = deque(maxlen=16)
        self._reached: dict[int, tuple[int, int]] = {}
        self._keys: dict[tuple[int, ...], tuple[int, int]] = {}

    def add(self, items: tuple[int, ...], n: int) -> None:
        if items and n:
            self.groups[items] += n
            if room := self.capacity - sum(items):
                if self.groups[items] == n:
                    if room not in self.by_room:
                        self.by_room[room] = []
                        bisect.insort(self.rooms, room)
                    bisect.insort(self.by_room[room], items)
                    bisect.insort(self.underfull, (self.capacity - room, items))
                    self._reached.pop(room, None)
                self.clock += 1
                self.came[room] = self.clock
                self.late.append(room)

    def take(self, items: tuple[int, ...], n: int) -> None:
        self.groups[items] -= n
        if not self.groups[items]:
            del self.groups[items]
            if room := self.capacity - sum(items):
                some = self.by_room[room]
                del some[bisect.bisect_left(some, items)]
                del self.underfull[bisect.bisect_left(self.underfull, (self.capacity - room, items))]
                self._reached.pop(room, None)
                if not some:
                    del self.by_room[room], self.rooms[bisect.bisect_left(self.rooms, room)]

    def _bits(self, items: tuple[int, ...]) -> tuple[int, int]:
        """The lengths of a group and the sums of its pairs, as bits."""
        found = self._keys.get(items)
        if found is None:
            ones = twos = 0
            distinct = sorted(set(items))
            for x in distinct:
                ones |= 1 << x
            for k, x in enumerate(distinct):
                for y in distinct[:k]:
                    twos |= 1 << x + y
                if items.count(x) > 1:
                    twos |= 1 << 2 * x
            found = self._keys[items] = ones, twos
        return found

    def _reach(self, room: int, groups: Iterable[tuple[int, ...]]) -> tuple[int, int]:
        """Lengths, and sums of two, for which one of these groups can give nothing, one or two pieces and become fuller."""
        ones = twos = 0
        for items in groups:
            one, two = self._bits(items)
            ones, twos = ones | one, twos | two

        def spread(bits: int) -> int:
            """Every bit at the next ``room`` places, without its own place."""
            bits, done = bits << 1, 1
            while done < room:
                step = min(done, room - done)
                bits, done = bits | bits << step, done + step
            return bits

        return spread(1 | ones | twos), spread(ones)

    @classmethod
    def of(cls, groups: dict[tuple[int, ...], int], capacity: int) -> BinGroups:
        out = cls(capacity)
        for items, n in groups.items():
            out.add(items, n)
        return out

    @classmethod
    def best_fit(cls, lengths: dict[int, int], capacity: int, order: Iterable[int] | None = None) -> BinGroups:
        """Best fit over counts of lengths, one length after the other: the longest first or in the given order."""
        by_room: dict[int, Counter] = {}
        rooms: list[int] = []

        def put(items: tuple[int, ...], n: int) -> None:
            room = capacity - sum(items)
            if room not in by_room:
                by_room[room] = Counter()
                bisect.insort(rooms, room)
            by_room[room][items] += n

        for length in order or sorted(lengths, reverse=True):
            left = lengths[length]
            while left:
                k = bisect.bisect_left(rooms, length)
                if k == len(rooms):
                    each = capacity // length
                    if left >= each:
                        put((length,) * each, left // each)
                    if left % each:
                        put((length,) * (left % each), 1)
                    break
                room = rooms[k]
                items, n = next(iter(by_room[room].items()))
                many = min(n, left)
                if many == n:
                    del by_room[room][items]
                    if not by_room[room]:
                        del by_room[room], rooms[k]
                else:
                    by_room[room][items] -= many
                put((*items, length), many)
                left -= many
        return cls.of({items: n for some in by_room.values() for items, n in some.items()}, capacity)

    def _exchange(self, giver: tuple[int, ...], taker: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The move, one-for-one or two-for-one exchange that fills ``taker`` most; each raises the squared fill."""
        room = self.capacity - sum(taker)
        best, gain = None, 0
        for x in set(giver):
            if gain < x <= room:
                best, gain = ((x,), ()), x
        for x in set(giver):
            for y in set(taker):
                if gain < x - y <= room:
                    best, gain = ((x,), (y,)), x - y
        if gain < room:
            pairs = lambda items: {(items[i], items[j]) for i in range(len(items)) for j in range(i)}
            for a, b in pairs(giver):
                for y in set(taker):
                    if gain < a + b - y <= room:
                        best, gain = ((a, b), (y,)), a + b - y
            for a, b in pairs(taker):
                for x in set(giver):
                    if gain < x - a - b <= room:
                        best, gain = ((x,), (a, b)), x - a - b
        if best is None:
            return None

        def without(items, gone, new):
            items = list(items)
            for x in gone:
                items.remove(x)
            return tuple(sorted([*items, *new], reverse=True))

        out, back = best
        return without(giver, out, back), without(taker, back, out)

    def _partner(self, giver: tuple[int, ...], room: int):
        """The taker of this room that an exchange with ``giver`` fills, and what becomes of both."""
        ones, twos = self._bits(giver)
        groups = self.by_room.get(room, ())
        if room not in self._reached:
            self._reached[room] = self._reach(room, groups)
        one, two = self._reached[room]
        if not (ones & one or twos & two):
            return None
        for taker in reversed(groups):
            if giver == taker and self.groups[giver] < 2:
                continue
            one, two = self._reach(room, [taker])
            if (ones & one or twos & two) and (found := self._exchange(giver, taker)):
                return taker, found
        return None

    def search(self, max_steps: int | None = None) -> int:
        """Exchange between underfull bins, the emptiest giving to fuller ones, until nothing improves.

        Every pair of groups counts: a giver asks each room at once, by bits of
        lengths, and later only the rooms where groups came since. It also ends
        when there are no more bins than the total length needs. Returns the
        steps.
        """
        steps, asked = 0, {}
        needed, bins = self.needed(), self.bins()
        while bins > needed and (max_steps is None or steps < max_steps):
            late = [*self.late]
            for fill, giver in self.underfull:
                own, since = self.capacity - fill, asked.get(giver, 0)
                if self.clock - since < len(late):
                    rooms = sorted({r for r in late[since - self.clock :] if r <= own}) if since < self.clock else ()
                else:
                    rooms = [r for r in self.rooms[: bisect.bisect_right(self.rooms, own)] if self.came[r] > since]
                found = next(filter(None, (self._partner(giver, r) for r in rooms)), None)
                if found:
                    break
                asked[giver] = self.clock
            else:
                break
            taker, after = found
            n = self.groups[giver] // 2 if giver == taker else min(self.groups[giver], self.groups[taker])
            self.take(giver, n)
            self.take(taker, n)
            for items in after:
                self.add(items, n)
                bins -= 0 if items else n
            steps += 1
        return steps

    def bins(self) -> int:
        return sum(self.groups.values())

    def needed(self) -> int:
        """The bins that the total length fills at least."""
        return -(-sum(sum(g) * n for g, n in self.groups.items()) // self.capacity)

    def shake(self, rnd: random.Random) -> None:
        """Take the pieces out of all underfull bins and of about as many full ones and deal them anew by best fit."""
        some = [(items, self.groups[items]) for _, items in self.underfull]
        left = sum(n for _, n in some)
        full = [items for items in self.groups if sum(items) == self.capacity]
        rnd.shuffle(full)
        share = max(1, left // 8)
        for items in full:
            if left <= 0:
                break
            some.append((items, min(self.groups[items], share)))
            left -= some[-1][1]
        lengths: Counter = Counter()
        for items, n in some:
            self.take(items, n)
            for x in items:
                lengths[x] += n
        for items, n in self.best_fit(lengths, self.capacity).groups.items():
            self.add(items, n)

    def plan(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, end rank, first sequence, offset): where the pieces of each length go."""
        used, rows, sequence = Counter(), [], 0
        for items, n in sorted(self.groups.items(), reverse=True):
            offset = 0
            for length in items:
                rows.append((length, used[length], used[length] + n, sequence, offset))
                used[length] += n
                offset += length
            sequence += n
        return rows


def packed_groups(lengths: dict[int, int], capacity: int, patience: int = PATIENCE, seed: int = 17) -> tuple[BinGroups, list[int]]:
    """The packing of counts of lengths, and the number of bins of the first packing and after each search.

    The rounds end at the lower bound, or when ``patience`` of them in a row gave
    no fewer bins; one that gave more is undone and counts for ``WORSE``. Best-fit decreasing is the yardstick: where it needs fewer
    bins, it takes the search's place.
    """
    rnd = random.Random(seed)
    order = sorted(lengths)
    rnd.shuffle(order)
    groups = BinGroups.best_fit(lengths, capacity, order)
    history = [groups.bins()]
    groups.search()
    history.append(groups.bins())
    idle = 0
    while groups.bins() > groups.needed() and idle < patience:
        before = dict(groups.groups)
        groups.shake(rnd)
        groups.search()
        more = groups.bins() - history[-1]
        idle = 0 if more < 0 else idle + 1 if more == 0 else idle + WORSE
        if more > 0:
            groups = BinGroups.of(before, capacity)
        history.append(groups.bins())
    yardstick = BinGroups.best_fit(lengths, capacity)
    if yardstick.bins() < groups.bins():
        yardstick.search()
        groups = yardstick
    return groups, history


def pack(pieces: DataFrame, capacity: int = CAPACITY, patience: int = PATIENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Each piece is placed once; a sequence's pieces lie without gaps from 0.
    Pieces of one length are alike, ties go by their place in the table.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    groups, _ = packed_groups(lengths, capacity, patience)
    plan = groups.plan()
    places = local_table(spark, plan, "length long, first_rank long, end_rank long, first_sequence long, offset long")
    buckets = {k: -(-n // ROWS_PER_BUCKET) for k, n in lengths.items()}
    dealt = local_table(spark, [*buckets.items()], "length long, _buckets long")  # a row a length: at most ``capacity``
    ranked = pieces.join(F.broadcast(dealt), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets"))).drop("_buckets")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranked.groupBy("length", "_bucket").count().select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1
    ranked = ranked.withColumn("_local", local)
    ranked = ranked.join(maybe_broadcast(starts, sum(buckets.values())), ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    fits = (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    placed = ranked.join(maybe_broadcast(places, len(plan)), fits).drop(places["length"])
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).select(*(c for c in pieces.columns if c != "_row"), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces made with ids: the token ids of every sequence in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(run, "sequence_id long, ids array<int>")
