"""Benchmark decontamination by a broadcast hash set of normalised test windows.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII
characters. A benchmark item gives every window of ``n`` consecutive words; an
item with fewer words is one window. Documents are scanned window by window
against the hash set, every hit is verified against the words themselves, and
hit spans or whole documents are removed.

Defined results: a null text has no words and is clean; items without words
have no window; equal items are counted under each of their ids, repeated rows
of an item once; an empty benchmark hits nothing; repeated documents get a row
each; null ids of documents stay, of items are ignored; a document of exactly
the limit's share is dropped; other columns are kept by the removal and not read
by the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, maybe_broadcast, written
from marlstone.llm.tokens import ALNUM, Words, scan_column

#: Words of the benchmark that may be broadcast at once (about 40 bytes each); larger benchmarks take several passes of so many.
MAX_WINDOWS = 2_000_000


def normalised_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words, n_words)``: the distinct items that have words, these joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = [], []
            for _, _, w in scan_column(batch.column(1), ALNUM, lower=True):
                words += [w.text(a, b - a) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                n += np.diff(w.first).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["item", "words", "n_words"])

    slim = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return slim.mapInArrow(run, "item string, words binary, n_words long").where("n_words > 0").distinct()


@dataclass
class Windows:
    """The windows of one size: sorted hashes with the item and the bytes that each stands for, and a filter of hash bits."""

    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray
    filter: np.ndarray

    def maybe(self, h: np.ndarray) -> np.ndarray:
        return self.filter[(h & np.uint64(len(self.filter) - 1)).astype(np.int64)]


@dataclass
class WindowSet:
    """The broadcast form of items: their words, and for each window size the sorted hashes of the windows in them."""

    names: list[str]
    data: np.ndarray
    sizes: dict[int, Windows]
    #: What the hashes met so far stand for, and the items with these words.
    met: dict[tuple[int, int], list[tuple[bytes, list[str]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, table: pa.Table, n: int) -> WindowSet:
        names, by, data, base = table["item"].to_pylist(), {}, [np.zeros(0, np.uint8)], 0
        words = table["words"].cast(pa.large_binary()).cast(pa.large_string())
        for first, _, w in scan_column(words, ALNUM):
            sizes = np.diff(w.first)
            for k in sorted({min(n, int(s)) for s in sizes if s}):
                at, h = w.windows(k)
                doc = w.doc[at]
                ok = sizes[doc] == k if k < n else np.ones(len(at), bool)
                at = at[ok]
                by.setdefault(k, []).append((h[ok], first + doc[ok], base + w.start[at], base + w.end[at + k - 1]))
            data.append(w.data)
            base += len(w.data)
        out = cls(names, np.concatenate(data), {})
        for k, parts in by.items():
            h, item, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << max(12, (8 * len(h)).bit_length()), bool)
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            out.sizes[k] = Windows(h[order], item[order].astype(np.int32), start[order], end[order], bits)
        return out

    def _standing_for(self, k: int, row: int) -> list[tuple[bytes, list[str]]]:
        """The words behind the hash at ``row`` (more than one where hashes collide), each with its items."""
        found = self.met.get((k, row))
        if found is None:
            one, by = self.sizes[k], {}
            for r in range(row, int(np.searchsorted(one.hashes, one.hashes[row], "right"))):
                by.setdefault(self.data[one.start[r] : one.end[r]].tobytes(), set()).add(self.names[one.item[r]])
            found = self.met[k, row] = [(words, sorted(items)) for words, items in by.items()]
        return found

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every verified occurrence, in no order."""
        for k, known in self.sizes.items():
            at, h = w.windows(k)
            ok = known.maybe(h)
            at, h = at[ok], h[ok]
            row = np.searchsorted(known.hashes, h)
            ok = known.hashes[np.minimum(row, len(known.hashes) - 1)] == h
            for a, r in zip(at[ok].tolist(), row[ok].tolist(), strict=True):
                text = w.text(a, k)
                for words, items in self._standing_for(k, r):
                    if words == text:
                        yield a, k, items


def _window_parts(items: DataFrame, n: int, max_windows: int) -> list[Callable[[], WindowSet]]:
    """What loads each part of the benchmark; one within the bound is one part. The benchmark is scanned once."""
    whole = written(normalised_items(items), "items")
    total = whole.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(1, -(-total // max_windows))
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    return [lambda p=p: WindowSet.of(whole.where(part == p).select("item", "words").toArrow(), n) for p in range(parts)]


def load_window_sets(items: DataFrame, n: int, max_windows: int = MAX_WINDOWS) -> list[WindowSet]:
    """The benchmark's windows in sets of about ``max_windows`` words each.

    The words are counted first. A benchmark within the bound makes one set; a
    larger one is split by the items' hash, each part a pass. An item is never
    split.
    """
    return [load() for load in _window_parts(items, n, max_windows)]


def _covered(w: Words, one: WindowSet) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Flags of hit words, and the items that occur in each document."""
    edge = np.zeros(len(w.hashes) + 1, np.int32)
    by_doc: dict[int, set[str]] = {}
    doc = w.doc
    for a, k, items in one.hits(w):
        edge[a] += 1
        edge[a + k] -= 1
        by_doc.setdefault(int(doc[a]), set()).update(items)
    return np.cumsum(edge[:-1]) > 0, by_doc


def _slim_items(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))


def scan_documents(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row a document: id, n_words, n_hit, the sorted ids of the items that occur in it, and hit spans.

    ``spans`` are (start, end) byte offsets of the UTF-8 text, one for each
    maximal run of hit words. Each pass over a part of the benchmark adds to
    what the passes before it found.
    """
    parts = _window_parts(_slim_items(items, item_col, item_text), n, max_windows)
    return _scan(docs, parts, id_col, text_col)


def _scan(docs: DataFrame, parts: list[Callable[[], WindowSet]], id_col: str, text_col: str) -> DataFrame:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    none = F.array().cast("array<struct<start:long,end:long>>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), none.alias("spans"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    for k, load in enumerate(parts):
        last = k == len(parts) - 1
        shared = docs.sparkSession.sparkContext.broadcast(load())
        rows = rows.mapInArrow(_scanner(shared, span, keep_text=not last), schema)
        if not last:
            rows = written(rows, "scanned")
            shared.unpersist()
    return rows.drop("text").withColumnRenamed("id", id_col)


def _scanner(shared, span: pa.DataType, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.select(["items", "spans"]).to_pydict()
            n_words, n_hit, names, spans = [], [], [], []
            for first, _, w in scan_column(batch.column(1), ALNUM, lower=True):
                hit, by_doc = _covered(w, shared.value)
                for d in range(len(w.first) - 1):
                    for s in before["spans"][first + d]:
                        a, b = np.searchsorted(w.start, [w.doc_start[d] + s["start"], w.doc_start[d] + s["end"]])
                        hit[a:b] = True
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(np.diff(w.first))
                n_hit.append(total[w.first[1:]] - total[w.first[:-1]])
                for d in range(len(w.first) - 1):
                    old = before["items"][first + d]
                    names.append(sorted({*old, *by_doc[d]}) if d in by_doc else old)
                    spans.append(_runs(w, hit, d) if d in by_doc or old else [])
            text = batch.column(1) if keep_text else pa.nulls(batch.num_rows, batch.column(1).type)
            counts = [pa.array(np.concatenate(x or [[]]), pa.int64()) for x in (n_words, n_hit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *counts, pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], names=["id", "text", "n_words", "n_hit", "items", "spans"])

    return run


def _runs(w: Words, hit: np.ndarray, d: int) -> list[dict]:
    a, b = w.first[d], w.first[d + 1]
    flags = np.concatenate([[False], hit[a:b], [False]])
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    base = w.doc_start[d]
    return [{"start": int(w.start[a + x] - base), "end": int(w.end[a + y - 1] - base)} for x, y in zip(edges[::2], edges[1::2], strict=True)]


def _without(text: bytes, spans: list[dict]) -> bytes:
    pieces, at = [], 0
    for r in spans:
        pieces.append(text[at : r["start"]])
        at = r["end"]
    return b"".join([*pieces, text[at:]])


def _cut(text: bytes, one: WindowSet) -> bytes:
    """Remove hit runs until none is left (a cut may join words into a new hit)."""
    while True:
        runs = []
        for _, _, w in scan_column(pa.array([text.decode()]), ALNUM, lower=True):
            hit, _ = _covered(w, one)
            runs = _runs(w, hit, 0)
        if not runs:
            return text
        text = _without(text, runs)


def _remove_by_parts(docs: DataFrame, parts: list[Callable[[], WindowSet]], drop_from: float, text_col: str) -> DataFrame:
    """The removal for several parts of a benchmark, with the results of one pass.

    All parts are scanned before anything is cut, so drops and cuts see the
    whole benchmark's hits on one text. The changed rows are scanned and cut
    again until no part hits them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t.encode(), s).decode() for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_row", "_new"])

    row, new = fresh(docs, "row"), fresh(docs, "new")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    now, gone, changed = rows.select(F.col(row).alias("_row"), F.col(f"`{text_col}`").alias("_new")), None, None
    while True:
        hit = written(_scan(now, parts, "_row", "_new").where("n_hit > 0").select("_row", "spans", (F.col("n_hit") / F.col("n_words")).alias("share")), "hit")
        if not (n := hit.count()):
            break
        if gone is None:
            gone, hit = hit.where(F.col("share") >= drop_from).select("_row"), hit.where(F.col("share") < drop_from)
        now = written(now.join(maybe_broadcast(hit, n), "_row").select("_row", "_new", "spans").mapInArrow(cut, "_row long, _new string"), "cut")
        changed = now if changed is None else written(changed.join(maybe_broadcast(now.select("_row"), n), "_row", "left_anti").unionByName(now), "changed")
    if gone is None:
        return rows.drop(row)
    left = rows.join(maybe_broadcast(gone.withColumnRenamed("_row", row)), row, "left_anti").join(changed.select(F.col("_row").alias(row), F.col("_new").alias(new)), row, "left")
    return left.select(*(F.coalesce(new, F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def remove_contamination(docs: DataFrame, items: DataFrame, n: int = 10, drop_from: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents, all columns kept, without the hit passages.

    Hit runs of words are cut out of a document; one with at least
    ``drop_from`` of its words hit is dropped. Clean rows pass unchanged. A
    benchmark over the bound is scanned part by part with the same results.
    Null and empty texts pass; ids are not read, repeated rows are treated each;
    columns may have any name; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def remover(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, keep, new = batch.column(at), np.ones(batch.num_rows, bool), {}
                for first, _, w in scan_column(column, ALNUM, lower=True):
                    hit, by_doc = _covered(w, shared.value)
                    for d in by_doc:
                        keep[first + d] = hit[w.first[d] : w.first[d + 1]].mean() < drop_from
                        if keep[first + d]:
                            new[first + d] = _cut(column[first + d].as_py().encode(), shared.value).decode()
                if new:
                    texts = column.to_pylist()
                    for row, text in new.items():
                        texts[row] = text
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
                yield batch.filter(pa.array(keep))

        return run

    parts = _window_parts(_slim_items(items, item_col, item_text), n, max_windows)
    if len(parts) > 1:
        return _remove_by_parts(docs, parts, drop_from, text_col)
    return docs.mapInArrow(remover(docs.sparkSession.sparkContext.broadcast(parts[0]())), docs.schema)
