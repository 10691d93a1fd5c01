"""Collocations mined by vertical positional inverted lists.

Documents are put into blocks of about half a million words. A block numbers its
words, leaving a hole at every border of a piece or document, and holds for
each word the sorted list of its positions. The list of a longer phrase comes
from merge-joining the phrase's positions with the postings of the words that
stand right behind it; its length is the phrase's exact frequency in the block.
Spark sums these by chunks of the candidates: a block sends a chunk its
candidates and counts as one packed row, and gets back which of them are
frequent over all blocks, under numbers that are unique in the corpus. So only
frequent phrases are extended, level by level, and from the second level on only
by the last words of frequent phrases that start one place on: no part of a
frequent phrase is less frequent.

Nothing is broadcast that grows with the corpus. Words are told apart by their
label and bytes; where two of one block have one 64-bit hash, that is an error.

Defined results: a null text is empty and a null label ``und``; a document
without words adds nothing; repeated rows count each; an empty table gives an
empty result; other columns are not read; ids are not needed. Of equal scores
the more frequent, then the phrase that comes first in byte order ranks first. A
block holds whole documents, so a document longer than a block is one by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import maybe_broadcast, settings, written
from marlstone.llm.tokens import byte_class, mix, scan_column, word_hashes

#: Words of a block; its arrays take some 200 bytes a word while it is made.
BLOCK_WORDS = 1 << 19
#: Words whose bytes are compared at once.
COMPARED = 1 << 16
#: Candidates' counts are summed in chunks of their keys, one for so many words of the corpus.
CHUNK_WORDS = 1 << 20
#: Numbers of frequent words and phrases are below this.
NUMBERS = 1 << 31
#: Blocks are wide rows: few of them are decoded at once.
WIDE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "4", "spark.sql.parquet.compression.codec": "zstd"}

BORDER = byte_class([*b".,;:!?", *range(0x0A, 0x0E)])
IN_WORD = ~(BORDER | byte_class(b" \t"))


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, of 4 bytes where these suffice."""
    steps = np.diff(numbers.astype(np.int64), prepend=0)
    small = not len(steps) or (-1 << 31) <= steps.min() <= steps.max() < 1 << 31
    return (b"4" if small else b"8") + pa.compress(steps.astype(np.int32 if small else np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    kind = np.dtype(np.int32 if data[:1] == b"4" else np.int64)
    return np.cumsum(np.frombuffer(pa.decompress(data[1:], kind.itemsize * n, codec="zstd", asbytes=True), kind), dtype=np.int64) if n else np.zeros(0, np.int64)


def _lists(columns: dict[str, np.ndarray | pa.Array]) -> dict[str, pa.Array]:
    """Each array as the only row of a list column."""
    return {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for k, v in columns.items()}


def _bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``data[start : start + size]`` one after another."""
    ends = np.cumsum(size)
    small = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - size)).astype(small), size)
    at += np.arange(len(at), dtype=small)
    return data[at]


def _spelled(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Words joined by line feeds, which no word has."""
    return np.insert(_bytes(data, start, size), np.cumsum(size)[:-1], 0x0A).tobytes()


def postings(docs: DataFrame, label: str = "lang", text: str = "text") -> DataFrame:
    """One row a block: of its ``m`` words the spelling, the place of their label and the occurrences (``sizes``), the ``n`` positions by word, and the words by label."""

    def block_of(number: int, parts: list, labels: list[str]) -> pa.RecordBatch:
        bases = np.cumsum([0, *(len(p[0].data) for p in parts)])
        data = np.concatenate([p[0].data for p in parts])
        start = np.concatenate([p[0].start + b for p, b in zip(parts, bases, strict=False)])
        size = np.concatenate([p[0].end - p[0].start for p in parts])
        key = np.concatenate([p[1] for p in parts])
        place = np.concatenate([p[2] for p in parts])
        which = np.concatenate([p[3] for p in parts])
        position = np.arange(len(key)) + np.cumsum(place)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        n = np.diff(np.append(first, len(order)))
        one = order[first]
        again = np.repeat(one, n)
        alike = (which[order] == which[again]).all() and (size[order] == size[again]).all()
        for a in range(0, len(order) if alike else 0, COMPARED):
            x, y = order[a : a + COMPARED], again[a : a + COMPARED]
            alike = alike and (_bytes(data, start[x], size[x]) == _bytes(data, start[y], size[y])).all()
        if not alike:
            raise ValueError("two words of one hash")
        spelled = _spelled(data, start[one], size[one])
        packed = {"words": pa.compress(spelled, codec="zstd", asbytes=True), "label": _packed(which[one]), "sizes": _packed(n), "positions": _packed(position[order])}
        columns = {"block": pa.array([number], pa.int64()), "m": pa.array([len(n)], pa.int32()), "n": pa.array([len(key)], pa.int64()), "bytes": pa.array([len(spelled)], pa.int64())}
        columns |= {k: pa.array([v], pa.binary()) for k, v in packed.items()}
        columns |= _lists({"labels": pa.array(labels, pa.string()), "label_words": np.bincount(which, minlength=len(labels)).astype(np.int64)})
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held, known = TaskContext.get().partitionId() << 32, [], 0, {}
        for batch in batches:
            own_label = np.array([known.setdefault("und" if x is None else x, len(known)) for x in batch.column(0).to_pylist()], np.int64)
            salt = np.array([xxhash.xxh3_64_intdigest(x) for x in known], np.uint64)
            for first, stop, words in scan_column(batch.column(1), IN_WORD, lower=True):
                if not len(words.hashes):
                    continue
                doc = words.doc
                label = own_label[first:stop][doc]
                borders = np.cumsum(BORDER[words.data])[words.start]
                hole = np.ones(len(doc), np.int64)
                hole[1:] = (doc[1:] != doc[:-1]) | (borders[1:] != borders[:-1])
                parts.append((words, mix(words.hashes ^ salt[label]), hole, label))
                held += len(doc)
                if held >= BLOCK_WORDS:
                    full, parts, held = parts, [], 0
                    yield block_of(number, full, list(known))
                    number += 1
        if parts:
            yield block_of(number, parts, list(known))

    slim = docs.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "block long, m int, n long, bytes long, words binary, label binary, sizes binary, positions binary, labels array<string>, label_words array<long>")


@dataclass
class Lists:
    """The phrases of ``k`` words of a block: their keys, ascending, and of every occurrence the phrase's place among them and the start."""

    k: int
    keys: np.ndarray
    phrase: np.ndarray
    start: np.ndarray

    def only(self, places: np.ndarray, numbers: np.ndarray) -> Lists:
        """The lists of the phrases at some places, under new keys."""
        order = np.argsort(numbers)
        new = np.full(len(self.keys), -1)
        new[places[order]] = np.arange(len(places))
        phrase = new[self.phrase]
        return Lists(self.k, numbers[order], phrase[phrase >= 0], self.start[phrase >= 0])

    def by_position(self) -> Lists:
        order = np.argsort(self.start)
        return Lists(self.k, self.keys, self.phrase[order], self.start[order])

    def extended(self, tail: Lists) -> Lists:
        """Every phrase with each word that stands right behind it; the keys name both. ``tail`` are postings of words by position."""
        behind = self.start + self.k
        at = np.searchsorted(tail.start, behind)
        at[at == len(tail.start)] = 0
        met = tail.start[at] == behind if len(tail.start) else np.zeros(len(behind), bool)
        keys, phrase = np.unique((self.keys[self.phrase[met]] << 32) | tail.keys[tail.phrase[at[met]]], return_inverse=True)
        return Lists(self.k + 1, keys, phrase, self.start[met])

    def sizes(self) -> np.ndarray:
        return np.bincount(self.phrase, minlength=len(self.keys))

    def packed(self) -> list:
        order = np.argsort(self.phrase, kind="stable")
        return [len(self.keys), _packed(self.keys), len(self.start), _packed(self.sizes()), _packed(self.start[order])]

    @staticmethod
    def unpacked(k: int, m: int, keys: bytes, n: int, sizes: bytes, positions: bytes) -> Lists:
        return Lists(k, _unpacked(keys, m), np.repeat(np.arange(m), _unpacked(sizes, m)), _unpacked(positions, n))


#: What a level hands on: of a block (chunk null) the candidates' lists, and for each chunk of keys their counts.
LEVEL = "block long, chunk int, m int, keys binary, n long, sizes binary, positions binary"
_LEVEL = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("n", pa.int64()), ("sizes", pa.binary()), ("positions", pa.binary())])
ANSWER = "block long, m int, keys binary, numbers binary, key array<long>, number array<long>, a array<long>"
_ANSWER = pa.schema([("block", pa.int64()), ("m", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), *((name, pa.list_(pa.int64())) for name in ("key", "number", "a"))])


WORD = "block long, chunk int, m int, keys binary, sizes binary, bytes long, words binary, label binary, labels array<string>"
_WORD = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.int64()), ("words", pa.binary()), ("label", pa.binary()), ("labels", pa.list_(pa.string()))])
WORD_ANSWER = "block long, m int, keys binary, numbers binary, number array<long>, label array<string>, word array<string>, a array<long>"
_WORD_ANSWER = pa.schema([("block", pa.int64()), ("m", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("number", pa.list_(pa.int64())), ("label", pa.list_(pa.string())), ("word", pa.list_(pa.string())), ("a", pa.list_(pa.int64()))])


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Wide rows one by one."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield {name: c[r].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}


def _counts(block: int, found: Lists, chunks: int) -> Iterator[list]:
    """The candidates of a block with their counts, a row for each chunk that has some."""
    chunk = (mix(found.keys.astype(np.uint64)) % np.uint64(chunks)).astype(np.int64)
    order, sizes = np.argsort(chunk, kind="stable"), found.sizes()
    for here in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else []:
        yield [block, int(chunk[here[0]]), len(here), _packed(found.keys[here]), None, _packed(sizes[here]), None]


def _pairs(row: dict) -> Lists:
    """The pairs of frequent words of a block."""
    every = np.arange(row["m"])
    words = Lists(1, every, np.repeat(every, _unpacked(row["sizes"], row["m"])), _unpacked(row["positions"], row["n"]))
    places, numbers = (np.concatenate([_unpacked(x[name], x["m"]) for x in row["known"]]) for name in ("keys", "numbers"))
    words = words.only(places, numbers).by_position()
    return words.extended(words)


def _count_words(chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of a block with their counts, a row for each chunk that has some; ``keys`` are their places in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data = np.frombuffer(pa.decompress(row["words"], row["bytes"], codec="zstd", asbytes=True), np.uint8)
            ends = np.append(np.flatnonzero(data == 0x0A), len(data))
            starts = np.append(0, ends[:-1] + 1)
            sizes, label = _unpacked(row["sizes"], row["m"]), _unpacked(row["label"], row["m"])
            chunk = (word_hashes(data, starts, ends) % np.uint64(chunks)).astype(np.int64)
            order, out = np.argsort(chunk, kind="stable"), []
            for here in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                spelled = _spelled(data, starts[here], (ends - starts)[here])
                out.append([row["block"], int(chunk[here[0]]), len(here), _packed(here), _packed(sizes[here]), len(spelled), pa.compress(spelled, codec="zstd", asbytes=True), _packed(label[here]), row["labels"]])
            yield _batch(out, _WORD)

    return run


def _word_answers(least: int, chunks: int) -> Callable[[pa.Table], pa.Table]:
    """The sums of one chunk of words: the frequent ones, with new numbers, for each block and as a whole."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(_WORD.names).to_pylist()
        known: dict[str, int] = {}
        label = np.concatenate([np.array([known.setdefault(x, len(known)) for x in r["labels"]], np.int64)[_unpacked(r["label"], r["m"])] for r in rows])
        spelled = pa.chunked_array([pa.array(pa.decompress(r["words"], r["bytes"], codec="zstd", asbytes=True).split(b"\n"), pa.binary()) for r in rows]).combine_chunks().dictionary_encode()
        words = spelled.dictionary
        every, at = np.unique(spelled.indices.to_numpy().astype(np.int64) * len(known) + label, return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpacked(r["sizes"], r["m"]) for r in rows])).astype(np.int64)
        frequent = total >= least
        number = (np.cumsum(frequent) - 1) * chunks + rows[0]["chunk"]
        if frequent.any() and number[-1] >= NUMBERS:
            raise ValueError("more frequent words than numbers")
        out, end = [], 0
        for r in rows:
            here = at[end : end + r["m"]]
            own, end = frequent[here], end + r["m"]
            if own.any():
                out.append([r["block"], int(own.sum()), _packed(_unpacked(r["keys"], r["m"])[own]), _packed(number[here[own]]), None, None, None, None])
        names = list(known)
        out.append([None, 0, None, None, number[frequent], [names[k] for k in every[frequent] % len(names)], words.take(pa.array(every[frequent] // len(names))).cast(pa.string()).to_pylist(), total[frequent]])
        return pa.Table.from_batches([_batch(out, _WORD_ANSWER)])

    return run


def _frequent(found: Lists, told: list[dict]) -> tuple[Lists, np.ndarray]:
    """The lists of the frequent candidates and the last word of each."""
    keys, numbers = (np.concatenate([_unpacked(x[name], x["m"]) for x in told]) for name in ("keys", "numbers"))
    return found.only(np.searchsorted(found.keys, keys), numbers), (keys & 0xFFFFFFFF)[np.argsort(numbers)]


def _step(k: int, longest: int, chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the frequent phrases of k words of each block to its candidates of k + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if k == 1:
                found = _pairs(row)
            else:
                lists = _pairs(row) if k == 2 else Lists.unpacked(k, *(row[x] for x in ("m", "keys", "n", "sizes", "positions")))
                phrases, last = _frequent(lists, row["told"])
                phrases = phrases.by_position()
                keys, word = np.unique(last, return_inverse=True)
                # the word behind a phrase ends the phrase that starts one place on, which is frequent too or the longer one is not
                found = phrases.extended(Lists(1, keys, word[phrases.phrase], phrases.start + k - 1))
            rows = list(_counts(row["block"], found, chunks))
            if 1 < k < longest - 1:
                rows.append([row["block"], None, *found.packed()])
            yield _batch(rows, _LEVEL)

    return run


def _answers(least: int, chunks: int) -> Callable[[pa.Table], pa.Table]:
    """The sums of one chunk: which candidates are frequent, with their new numbers, for each block and as a whole."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "chunk", "m", "keys", "sizes"]).to_pylist()
        keys = np.concatenate([_unpacked(r["keys"], r["m"]) for r in rows])
        every, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpacked(r["sizes"], r["m"]) for r in rows])).astype(np.int64)
        frequent = total >= least
        number = (np.cumsum(frequent) - 1) * chunks + rows[0]["chunk"]
        if frequent.any() and number[-1] >= NUMBERS:
            raise ValueError("more frequent phrases than numbers")
        out, end = [], 0
        for r in rows:
            here = at[end : end + r["m"]]
            here, end = here[frequent[here]], end + r["m"]
            if len(here):
                out.append([r["block"], len(here), _packed(every[here]), _packed(number[here]), None, None, None])
        out.append([None, 0, None, None, every[frequent], number[frequent], total[frequent]])
        return pa.Table.from_batches([_batch(out, _ANSWER)])

    return run


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, label: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All frequent phrases ``(words, a)`` with the words' numbers, the words ``(id, label, word)``, and the words by label ``(label, n)``."""
    spark = docs.sparkSession
    with settings(spark, WIDE_ROWS):
        blocks = written(postings(docs, label, text), "postings")
        by_label = written(blocks.select(F.inline(F.arrays_zip("labels", "label_words"))).groupBy(F.col("labels").alias("label")).agg(F.sum("label_words").alias("n")), "labels")
        chunks = 1 + (by_label.agg(F.sum("n")).first()[0] or 0) // CHUNK_WORDS
        counts = blocks.select(*(c for c in blocks.columns if c not in ("positions", "label_words"))).mapInArrow(_count_words(chunks), WORD)
        answers = written(counts.groupBy("chunk").applyInArrow(_word_answers(least, chunks), WORD_ANSWER), "frequent-1")
        words = answers.where("block is null").select(F.inline(F.arrays_zip(F.col("number").alias("id"), "label", "word", "a")))
        levels = [words.select("id", F.array("id").alias("words"), "a")]
        known = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("m", "keys", "numbers")).alias("known"))
        slim = blocks.select("block", "m", "n", "sizes", "positions").join(known, "block")
        lists = slim
        for k in range(1, longest):
            counts = lists.mapInArrow(_step(k, longest, chunks), LEVEL)
            if k > 1:
                counts = written(counts, f"lists-{k + 1}")
            answers = written(counts.where("chunk is not null").groupBy("chunk").applyInArrow(_answers(least, chunks), ANSWER), f"frequent-{k + 1}")
            told = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("m", "keys", "numbers")).alias("told"))
            lists = (slim if k == 1 else counts.where("chunk is null")).join(told, "block")
            new = answers.where("block is null").select(F.inline(F.arrays_zip("key", "number", "a")))
            new = new.select(F.shiftright("key", 32).alias("parent"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("last"), F.col("number").alias("id"), "a")
            before = levels[-1].select(F.col("id").alias("parent"), "words")
            levels.append(written(new.join(before, "parent").select("id", F.concat("words", F.array("last")).alias("words"), "a"), f"phrases-{k + 1}"))
        phrases = levels[0]
        for level in levels[1:]:
            phrases = phrases.unionByName(level)
        return phrases.select("words", "a"), words, by_label


def mine(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, absorbed: int = 100, label: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the collocations of each label.

    A phrase's score is that of its weakest cut, floor(1000 * a * n / (l * r)), in
    decimals of 38 digits. Phrases inside a longer one with ``absorbed`` percent
    of their frequency or more are dropped; the phrases that are longer by one word tell, as
    none that is longer still is more frequent than those.
    """
    phrases, words, totals = frequent_phrases(docs, longest, least, label, text)
    long = phrases.where(F.size("words") > 1)
    inside = long.where(F.size("words") > 2).select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), F.col("a").alias("b"))
    kept = long.join(inside.groupBy("words").agg(F.max("b").alias("b")), "words", "left").where(F.col("b").isNull() | (100 * F.col("b") < absorbed * F.col("a"))).select("words", "a")
    spelled = kept.select("words", F.posexplode("words").alias("i", "w")).join(words.select(F.col("id").alias("w"), "label", "word"), "w").groupBy("words").agg(F.first("label").alias("label"), F.array_join(F.sort_array(F.collect_list(F.struct("i", "word")))["word"], " ").alias("phrase"))
    cuts = kept.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select("*", F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    part = lambda name, to: phrases.select(F.col("words").alias(name), F.col("a").alias(to))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right").join(spelled, "words").join(maybe_broadcast(totals), "label")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * big("a") * big("n")).withColumn("under", big("l") * big("r"))
    best = cuts.withColumn("score", F.expr("over div under")).groupBy("words", "label", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("m.score"), F.desc("a"), "phrase"))
    ranked = best.select(F.col("label").alias("lang"), rank.cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
    return ranked.where(F.col("rank") <= top)
