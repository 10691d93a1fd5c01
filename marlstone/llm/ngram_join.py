"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct word n-grams. Tokens
are put in one global order, rare ones before frequent ones, and each document
indexes a prefix of its ordered set. Let x be the larger and y the smaller of
two documents with Jaccard >= t. Their overlap is at least ceil(t|x|) and at
least ceil(2t/(1+t) |y|), so x indexes its first |x| - ceil(t|x|) + 1 tokens,
and the shorter prefix that y needs is marked as leading: a candidate pair is
one whose smaller document leads.

* Rare tokens of the prefix are indexed one by one: two documents whose first
  common token is rare share one.
* Frequent tokens are indexed in combinations of two. When the first common
  token is frequent, so are all; the first m + 1 common tokens lie in both
  prefixes once these are extended by m, and of m + 1 tokens in m hash classes
  two share a class. So the pairs of frequent tokens within a class are
  indexed, about two for each prefix token.

m depends on the size band (floor of log2 |x|) that two documents share, and
a document near the upper end of its band is indexed for the next band too.
A document whose first 1 + |y| - ceil(2t/(1+t) |y|) tokens are all rare leads
by rare tokens alone. Under a key of frequent tokens it also matters how many
frequent tokens a document has at all: where these are fewer than the overlap
that a link to a partner needs, the two share a rare token and meet there. So
each entry has a reach, the greatest partner it needs, and entries that reach
no leading document of their key are left out at once: documents of one
template that differ in more words than a link allows meet nowhere, however
many they are.
Any order and any choice of "frequent" gives the same links; they only decide
how many candidates there are. Candidates whose parity sketches differ in more
bits than their sets may differ are refused (the sketch of a symmetric
difference never has more bits than it has tokens); the others are verified on
the texts.

Links are needed only for classes of linked documents. So equal sets are first
reduced to a representative, candidates then link each key's documents with
one of them (a star), the one whose tokens are the most frequent: in a group
of near copies that is the text they were copied from, or the one closest to
it. After the components of the verified links only pairs from different
components under one key remain, and of those only the ones that the sketches
let pass leave the join. A key of many such documents is cut into cells by
size class and by a hash of the larger document, so no task has all of it. No
group of copies is expanded into all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, maybe_broadcast, written
from marlstone.llm.graph import connected_components
from marlstone.llm.tokens import NOT_SPACE, Words, mix, scan_column

#: The frequent class holds at most so many tokens, the most frequent ones (8 MB). The rest count as rare.
MAX_FREQUENT = 1 << 20
#: A token is frequent from so many repetitions within batches on.
MIN_FREQUENT = 4
#: Pairs of texts whose shingles a Python worker holds at once.
PAIRS_AT_ONCE = 500
#: A key of more documents than this is cut into cells; results do not depend on it.
CELL_ROWS = 500

_ONE = np.uint64(1)
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; a shorter document is one shingle, one without words none."""
    at, h = w.windows(n)
    bounds = np.searchsorted(at, w.first)
    sizes = np.diff(w.first)
    short: dict[int, np.uint64] = {}
    for k in range(1, n):
        if (sizes == k).any():
            at_k, h_k = w.windows(k)
            doc = w.doc[at_k]
            ok = sizes[doc] == k
            short |= dict(zip(doc[ok].tolist(), h_k[ok], strict=True))
    none = np.zeros(0, np.uint64)
    for d in range(len(sizes)):
        if sizes[d] >= n:
            yield np.unique(h[bounds[d] : bounds[d + 1]])
        else:
            yield np.array([short[d]]) if d in short else none


def _sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, w in scan_column(column, NOT_SPACE, lower=True):
        yield from shingle_sets(w, n)


def frequent_tokens(docs: DataFrame, n: int, max_frequent: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their levels (log2 of their count).

    Every document is counted. A batch reports its tokens of two or more
    documents, so a token in more documents than there are batches is never
    missed; the reports are summed by Spark. The level from which tokens are
    taken follows from the (at most 64) level counts, so that no more than
    ``max_frequent`` tokens reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for one in _sets_of(batch.column(0), n):
                held.append(one)
                size += len(one)
                if size >= 250_000:
                    yield report(held)
                    held, size = [], 0
            if held:
                yield report(held)

    def report(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        twice = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[twice].view(np.int64)), pa.array(counts[twice])], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_FREQUENT)
    level = F.floor(F.log2("n")).cast("int")
    counts = written(counts.select("token", level.alias("level")), "frequent")
    lowest, total = 99, 0
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        if total + row["count"] > max_frequent:
            break
        lowest, total = row["level"], total + row["count"]
    found = counts.where(F.col("level") >= lowest).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["level"].to_numpy(np.uint8)[order]


def _ceil(t: Fraction, x: int) -> int:
    return -(-t.numerator * x // t.denominator)


def token_levels(tokens: np.ndarray, frequent: np.ndarray, levels: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), np.uint8)
    place = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return np.where(frequent[place] == tokens, levels[place], 0)


def reach(size: int, n_frequent: int, t: Fraction) -> tuple[int, int]:
    """The greatest partner of a document under keys of rare tokens and under those of frequent ones (see the module's text)."""
    most = min(size * t.denominator // t.numerator, (1 << 31) - 1)
    return most, max(0, min(most, n_frequent * (t.numerator + t.denominator) // t.numerator - size))


def prefix_keys(tokens: np.ndarray, t: Fraction, level: np.ndarray) -> tuple[np.ndarray, int]:
    """The index keys of one document, leading ones first, and the number of those (see the module's text).

    The lowest bit of a key says whether it is of frequent tokens.
    """
    size = len(tokens)
    if not size:
        return tokens, 0
    prefix = size - _ceil(t, size) + 1
    lead = size - _ceil(2 * t / (1 + t), size) + 1
    marked = (tokens & ~_ONE) | (level > 0).astype(np.uint64)
    small = size <= int(1 / t)  # such sets may share a single token only
    rare = marked[level == 0][:prefix]
    if len(rare) >= prefix and not small:
        first = np.unique(rare[:lead])
        return np.concatenate([first, np.setdiff1d(rare[lead:], first)]), len(first)
    own = size.bit_length() - 1
    bands = [own] + [own + 1] * (size >= t * (1 << (own + 1)))
    leading, others, often = [marked if small else rare[:lead]], [rare[lead:]], level > 0
    order = np.lexsort((tokens[often], level[often]))
    ordered = tokens[often][order]
    for band in bands:
        m = min(_ceil(1 - t, 1 << band), _ceil(t, 1 << band) - 1)
        some = ordered[: max(0, prefix + max(m, 0) - len(rare))]
        first = np.arange(len(some)) < (lead + max(m, 0) - len(rare) if len(rare) < lead else 0)
        if m < 1:
            leading.append(some[first] | _ONE)
            others.append(some[~first] | _ONE)
            continue
        group = ((some * _K1) >> np.uint64(33)) % np.uint64(m)
        by = np.lexsort((some, group))
        some, group, first = some[by], group[by], first[by]
        gap = 1
        while gap < len(some):
            same = group[gap:] == group[:-gap]
            if not same.any():
                break
            a, b = some[:-gap][same], some[gap:][same]
            keys = mix((mix(a * _K1) + b) * _K2 + np.uint64(band)) | _ONE
            both = (first[:-gap] & first[gap:])[same]
            leading.append(keys[both])
            others.append(keys[~both])
            gap += 1
    leading, others = np.unique(np.concatenate(leading)), np.unique(np.concatenate(others))
    return np.concatenate([leading, np.setdiff1d(others, leading, assume_unique=True)]), len(leading)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bit b says whether an odd number of tokens fall on b; about one to two bits a token."""
    bits = max(64, 1 << (max(1, len(tokens) - 1)).bit_length()) << (len(tokens) <= 256)
    place = (mix(tokens * _K2 + _K1) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<i8")


def index_documents(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """``(doc_id, n_shingles, s1, s2, centre, sketch, n_lead, often, keys)``; s1 and s2 sign the set, centre is its tokens' mean level, often its reach under frequent tokens."""
    sc = docs.sparkSession.sparkContext
    common = sc.broadcast(frequent_tokens(docs, n))

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, levels = common.value
        for batch in batches:
            for first, stop, w in scan_column(batch.column(1), NOT_SPACE, lower=True):
                size, s1, s2, centre, sketch, n_lead, often, keys = [], [], [], [], [], [], [], []
                for one in shingle_sets(w, n):
                    size.append(len(one))
                    s1.append(int(np.bitwise_xor.reduce(mix(one * _K1)).view(np.int64)) if len(one) else 0)
                    s2.append(int(np.add.reduce(mix(one * _K2 + _K1)).view(np.int64)) if len(one) else 0)
                    sketch.append(parity_sketch(one))
                    level = token_levels(one, frequent, levels)
                    centre.append(int(1000 * level.mean()) if len(one) else 0)
                    found, leading = prefix_keys(one, t, level)
                    keys.append(found)
                    n_lead.append(leading)
                    often.append(reach(len(one), int((level > 0).sum()), t)[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(centre, pa.int32()), lists(sketch), pa.array(n_lead, pa.int32()), pa.array(often, pa.int32()), lists(keys)],
                    names=["doc_id", "n_shingles", "s1", "s2", "centre", "sketch", "n_lead", "often", "keys"],
                )

    schema = "doc_id long, n_shingles long, s1 long, s2 long, centre int, sketch array<long>, n_lead int, often int, keys array<long>"
    index = written(docs.select("doc_id", "text").mapInArrow(run, schema), "index")
    common.unpersist()
    return index


def may_link(s_a: Column, s_b: Column, n_a: Column, n_b: Column, t: Fraction) -> Column:
    """False where two documents' sizes and parity sketches rule out a link."""

    def fold(s: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    to = lambda s, other: F.when(F.size(s) == 2 * F.size(other), fold(s)).otherwise(s)
    odd = F.aggregate(F.zip_with(to(s_a, s_b), to(s_b, s_a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + F.coalesce(v, F.lit(0)))
    total = n_a + n_b
    return odd <= total - 2 * F.ceil(total * t.numerator / (t.numerator + t.denominator) - 1e-6)


def possible(pairs: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that may link."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = side("a").join(maybe_broadcast(pairs), "a").join(side("b"), "b")
    return written(both.where(may_link(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), t)).select("a", "b"), "possible")


def verify(pairs: DataFrame, docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have Jaccard >= t, with ``common`` and ``total``."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = written(docs.join(maybe_broadcast(ids), "doc_id", "left_semi").where("text is not null"), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def sets_by_pair(ids: pa.Array, texts: pa.Array) -> Iterator[np.ndarray]:
        _, first, place = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
        sets = list(_sets_of(texts.take(pa.array(first)), n))
        return (sets[k] for k in place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PAIRS_AT_ONCE) for b in batches for k in range(0, b.num_rows, PAIRS_AT_ONCE)):
            common, total = [], []
            for x, y in zip(sets_by_pair(batch.column(0), batch.column(2)), sets_by_pair(batch.column(1), batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                total.append(len(x) + len(y) - both)
            common, total = np.array(common, np.int64), np.array(total, np.int64)
            yes = pa.array((common > 0) & (t.denominator * common >= t.numerator * total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(total)], names=["a", "b", "common", "total"]).filter(yes)

    joined = left.join(maybe_broadcast(pairs), "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(joined.mapInArrow(run, "a long, b long, common long, total long"), "links")


def _cells(t: Fraction, lead: bool) -> Column:
    """The cells of its key, which has ``n`` documents, that a row of ``size`` shingles goes to as the smaller (``lead``) or the larger one of a pair.

    Size classes are a factor of 1 / t wide, so a partner lies in the smaller
    document's class or the next. A larger document goes to one part of its
    class, the smaller one to all of them. A key that is not hot is one cell.
    """
    size_class = lambda size: F.floor(F.log(size.cast("double")) / F.lit(float(np.log(t.denominator / t.numerator))))
    if t == 1:
        size_class = lambda size: size.cast("long")
    parts = F.ceil(F.col("n") / CELL_ROWS)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("class"), F.lit(0).cast("long").alias("part")))
    if lead:
        most = F.floor(F.col("size").cast("long") * t.denominator / t.numerator + 1e-6)
        classes = F.sequence(size_class(F.col("size")), size_class(most))
        cut = F.flatten(F.transform(classes, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(c.alias("class"), p.alias("part")))))
    else:
        cut = F.array(F.struct(size_class(F.col("size")).alias("class"), F.pmod(F.xxhash64("rep"), parts).alias("part")))
    return F.when(parts > 1, cut).otherwise(whole)


def _join_keyed(docs: DataFrame, n: int, t: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """``(index, copies, links, components)`` of documents whose ids differ; null ids are in the index only.

    ``copies`` have the smallest id with an equal set as ``rep``; ``links`` are
    the verified pairs of those, ``components`` theirs where already known.
    """
    index = index_documents(docs, n, t)
    sets = index.where("n_shingles > 0 and doc_id is not null")
    classes = written(sets.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    copied = classes.where("last > rep")
    others = written(sets.select("doc_id", "s1", "s2", "n_shingles").join(maybe_broadcast(copied), ["s1", "s2", "n_shingles"]).where("doc_id > rep").select("doc_id", "rep"), "copies")
    first = sets.join(maybe_broadcast(others.select("doc_id").distinct()), "doc_id", "left_anti")
    entries = first.select(F.posexplode("keys").alias("pos", "key"), F.col("doc_id").alias("rep"), F.col("n_shingles").cast("int").alias("size"), "n_lead", "often", "centre")
    most = F.least(F.floor(F.col("size").cast("long") * t.denominator / t.numerator + 1e-6), F.lit((1 << 31) - 1).cast("long")).cast("int")
    entries = entries.select("key", "rep", "size", (F.col("pos") < F.col("n_lead")).alias("lead"), F.when(F.col("key").bitwiseAND(1) == 1, F.col("often")).otherwise(most).alias("reach"), "centre")
    sketches = first.select("doc_id", "n_shingles", "sketch")

    repeated = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("lead"), F.col("size"))).alias("least")).where("n > 1 and least is not null").select("key", "least")
    shared = written(entries.join(repeated, "key").where("size >= least and reach >= least").drop("least"), "shared")
    middle = shared.groupBy("key").agg(F.max(F.struct("centre", (-F.col("rep")).alias("neg"), "size", "lead", "reach")).alias("p"))
    stars = middle.select("key", (-F.col("p.neg")).alias("p_rep"), F.col("p.size").alias("p_size"), F.col("p.lead").alias("p_lead"), F.col("p.reach").alias("p_reach"))
    smaller = F.struct("size", "rep") < F.struct(F.col("p_size").alias("size"), F.col("p_rep").alias("rep"))
    meets = F.when(smaller, F.col("lead")).otherwise(F.col("p_lead")) & (F.col("p_size") <= F.col("reach")) & (F.col("size") <= F.col("p_reach"))
    near = shared.join(stars, "key").where((F.col("rep") != F.col("p_rep")) & meets).select(F.greatest("rep", "p_rep").alias("a"), F.least("rep", "p_rep").alias("b")).distinct()
    near = written(near, "near")
    links = verify(possible(near, sketches, t), docs, n, t)
    found = connected_components(links, "a", "b")

    label = F.coalesce(F.col("component"), F.col("rep"))
    labelled = shared.join(maybe_broadcast(found), shared["rep"] == found["node"], "left").select("key", "rep", "size", "lead", "reach", label.alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), F.max("lead").alias("any_lead")).where("low < high and any_lead").select("key", "n")
    rest = written(labelled.join(mixed, "key"), "mixed")
    drawn = written(sketches.join(maybe_broadcast(rest.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "sketch"), "drawn")
    longs = drawn.agg(F.coalesce(F.sum(F.size("sketch") + 1), F.lit(0))).first()[0]
    rest = rest.join(maybe_broadcast(drawn, longs), "rep")
    x = rest.withColumn("cell", F.explode(_cells(t, lead=False))).alias("x")
    y = rest.where("lead").withColumn("cell", F.explode(_cells(t, lead=True))).alias("y")
    larger = F.struct("x.size", "x.rep") > F.struct("y.size", "y.rep")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cell.class") == F.col("y.cell.class")) & (F.col("x.cell.part") == F.col("y.cell.part")) & larger & (F.col("x.c") != F.col("y.c")) & (F.col("x.size") <= F.col("y.reach")) & (F.col("y.size") <= F.col("x.reach")) & may_link(F.col("x.sketch"), F.col("y.sketch"), F.col("x.size"), F.col("y.size"), t))
    across = across.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    across = written(across.join(near, ["a", "b"], "left_anti"), "across")
    if across.isEmpty():
        return index, others, links, found
    return index, others, links.unionByName(verify(across, docs, n, t)), None


def _all_differ(ids: DataFrame, allow_null: bool) -> bool:
    """Whether no id of the column ``doc_id`` is repeated and, unless allowed, none is null."""
    counts = ids.groupBy("doc_id").count()
    return counts.where(F.when(F.col("doc_id").isNull(), F.lit(not allow_null)).otherwise(F.col("count") > 1)).isEmpty()


def _row_components(numbered: DataFrame, copies: DataFrame, links: DataFrame) -> DataFrame:
    """``(_row, component)`` of numbered rows that copies, links or one id tie to others."""
    first = numbered.where("doc_id is not null").groupBy("doc_id").agg(F.min("_row").alias("b"), F.max("_row").alias("last")).where("b < last")
    ties = numbered.join(first, "doc_id").where("_row > b").select(F.col("_row").alias("a"), "b")
    edges = links.select("a", "b").unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).unionByName(ties)
    return connected_components(edges, "a", "b").withColumnRenamed("node", "_row")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float | Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Link documents whose word n-gram sets have Jaccard >= threshold.

    Returns ``(members, links)``. ``members`` has a row for each input row:
    doc_id, n_shingles, representative (smallest id with an equal set) and
    component_id (smallest id reachable by links). ``links`` are verified pairs
    (a, b) of representatives with ``common`` and ``total`` shingles: enough of
    them to connect every component, without pairs inside a component that was
    already connected.

    Defined results: null and word-less texts have no shingles, are linked with
    nothing and are components of their own; a null id has null representative
    and component; repeated rows each get a row; rows with one id and different
    texts count as one document that has the links of each text; an empty table
    gives empty results; ids must be integers; other columns are not read.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if _all_differ(docs, allow_null=True):
        index, copies, links, found = _join_keyed(docs, n, t)
        found = connected_components(links, "a", "b") if found is None else found
        rows = index.select("doc_id", "n_shingles").join(copies, "doc_id", "left").withColumn("representative", F.coalesce("rep", "doc_id")).drop("rep")
        members = rows.join(maybe_broadcast(found), rows["representative"] == found["node"], "left").select("doc_id", "n_shingles", "representative", F.coalesce("component", "representative").alias("component_id"))
        return members, links
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    index, copies, links, _ = _join_keyed(numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text"), n, t)
    rows = index.select(F.col("doc_id").alias("_row"), "n_shingles").join(numbered.where("doc_id is not null").select("_row", "doc_id"), "_row", "left")
    rows = rows.join(copies.withColumnRenamed("doc_id", "_row"), "_row", "left").join(_row_components(numbered, copies, links), "_row", "left")
    rows = written(rows.select("doc_id", "n_shingles", F.coalesce("rep", "_row").alias("rep"), F.coalesce("component", "_row").alias("component")), "rows")
    named = rows.where("doc_id is not null")
    names = written(named.groupBy("rep").agg(F.min("doc_id").alias("representative")), "names")
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    members = rows.join(names, "rep", "left").join(lowest, "component", "left").select("doc_id", "n_shingles", "representative", "component_id")
    a, b = (names.select(F.col("rep").alias(x), F.col("representative").alias(f"id_{x}")) for x in ("a", "b"))
    links = links.join(a, "a").join(b, "b").where("id_a != id_b")
    return members, links.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"), "common", "total").distinct()


def keep_one_per_component(docs: DataFrame, n: int = 5, threshold: float | Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept: one row of each component, the first of its smallest id.

    Rows of one id belong to one component. A row with a null id is a document
    of its own and goes where its component has a row with an id, or an earlier
    one.
    """
    slim = lambda df, *more: df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *more)
    if _all_differ(slim(docs), allow_null=False):
        members, _ = ngram_jaccard_join(docs, n, threshold, id_col, text_col)
        gone = members.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
        gone = written(gone, "gone")
        return docs.join(maybe_broadcast(gone), id_col, "left_anti")
    row = fresh(docs, "row")
    whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    numbered = slim(whole, F.col(row).alias("_row"))
    _, copies, links, _ = _join_keyed(numbered.select(F.col("_row").alias("doc_id"), "text"), n, Fraction(threshold).limit_denominator(10_000))
    found = _row_components(numbered, copies, links).join(numbered.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    first = found.groupBy("component").agg(F.min(order).alias("first"))
    gone = written(found.join(first.select("component", F.col("first._row").alias("stays")), "component").where("_row != stays").select("_row"), "gone")
    return whole.join(maybe_broadcast(gone.withColumnRenamed("_row", row)), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
