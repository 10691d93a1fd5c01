"""Resharding and packing: exact round trips, laws and optimality on small cases."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import packing, resharding

TEXTS = [None, "", "a", "Hello, world!! HELLO", "don't <|endoftext|> <|ENDOFTEXT|> x", "éÉ e\u0301 ñ 日本語 ½²", "a\x1cb\x85c \u3000 d\u00a0e", "I'll we've THAT's o'clock", "1234 12a a12 --..!!", "word." * 50]


def random_texts(seed, n):
    rnd = random.Random(seed)
    alphabet = "abcXYZ019 .,!#'|éñß\n\t日\u0301<>"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(n)]


def test_word_ids_equal_whole_text_ids():
    encoder, whole = packing.WordEncoder(), packing._tokenizer(None)
    texts = [t or "" for t in TEXTS] + random_texts(4, 300)
    for t, got in zip(texts, encoder.ids([t.encode() for t in texts]), strict=True):
        ids = whole.encode(t, add_special_tokens=False).ids
        assert got == b"".join(i.to_bytes(4, "little") for i in ids), t


def same_ids(encoder, whole, texts):
    for t, got, e in zip(texts, encoder.ids([t.encode() for t in texts]), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == b"".join(i.to_bytes(4, "little") for i in e.ids), repr(t)


def test_word_ids_over_all_of_unicode():
    encoder, whole = packing.WordEncoder(), packing._tokenizer(None)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(every), 20_000):
        same_ids(encoder, whole, [f"{c}! A{c}.x {c}B?" for c in every[a : a + 20_000 : 1 if a < 0x3000 else 7]])
    rnd = random.Random(11)
    odd = ["\u0130", "!", "'", "s", "'s", "\u0301", "\u0338", "<", "=", "<|endoftext|>", "<|", "|>", "\x01", "\x1c", "\x85", "\u00a0", "\u200b", "\u03a3", "\u00df", "\u01c5", "1", "\u00b2", "\u00e9", "A", "\u65e5", "\u1100", "\u1161", " ", "\n"]
    same_ids(encoder, whole, ["".join(rnd.choice(odd) if rnd.random() < 0.8 else rnd.choice(every) for _ in range(rnd.randrange(12))) for _ in range(30_000)])


def test_search_alone_empties_bins_of_the_first_packing():
    rnd = random.Random(5)
    counts = Counter(rnd.choice([2048, rnd.randrange(1, 2049), rnd.randrange(1, 300)]) for _ in range(4000))
    groups, history = packing.packed_groups(counts, 2048)
    assert history[1] < history[0] and groups.bins() == min(history) == groups.needed()
    assert groups.bins() <= packing.BinGroups.best_fit(counts, 2048).bins()
    assert sum((Counter({x: n * g.count(x) for x in set(g)}) for g, n in groups.groups.items()), Counter()) == counts
    hard = Counter(rnd.randint(400, 900) for _ in range(800))
    groups, history = packing.packed_groups(hard, 2048)
    assert groups.bins() == min(history) <= packing.BinGroups.best_fit(hard, 2048).bins()


def test_ranks_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 7)
    pieces = spark.createDataFrame([(k, 5 + k % 3) for k in range(200)], "doc_id long, length long").repartition(5)
    fill = defaultdict(list)
    rows = packing.pack(pieces, 16).collect()
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(200))
    for some in fill.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 16


def test_packing_round_trip(spark):
    texts = TEXTS + random_texts(9, 40) + ["longer text here. " * 900] * 3
    docs = spark.createDataFrame([(k % 50 if k < 52 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    packed = packing.pack(packing.token_pieces(docs, with_ids=True))
    rows = packed.collect()
    by_sequence = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    whole = packing._tokenizer(None)
    expected = Counter()
    for k, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), packing.CAPACITY)):
            expected[(k % 50 if k < 52 else None, p, a, len(ids[a : a + packing.CAPACITY]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a : a + packing.CAPACITY])))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // packing.CAPACITY) + 2
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for s, parts in by_sequence.items():
        assert len(joined[s]) == sum(n for _, n in parts)
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0


def test_search_empties_bins():
    groups = packing.BinGroups(10)
    for items in ((6, 3), (7, 2), (4, 4), (1,), (1,)):
        groups.add(items, 1)
    before = Counter(x for g, n in groups.groups.items() for x in g * n)
    groups.search()
    after = Counter(x for g, n in groups.groups.items() for x in g * n)
    assert before == after and sum(groups.groups.values()) == 3 and all(sum(g) <= 10 for g in groups.groups)


def test_search_ends_only_when_no_exchange_is_left():
    rnd = random.Random(3)
    counts = Counter(rnd.randint(400, 900) for _ in range(3000))
    groups = packing.BinGroups.best_fit(counts, 2048)
    before = sum(groups.groups.values())
    groups.search()
    assert sum((Counter({x: n * g.count(x) for x in set(g)}) for g, n in groups.groups.items()), Counter()) == counts
    assert sum(groups.groups.values()) <= before - 25
    under = sorted((g for g in groups.groups if sum(g) < 2048), key=sum)
    pairs = [(a, b) for i, a in enumerate(under) for b in under[i:] if a != b or groups.groups[a] > 1]
    assert all(groups._exchange(*p) is None for p in rnd.sample(pairs, min(len(pairs), 20_000)))


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.choice([rnd.randrange(1, 65), 64, 33]) for _ in range(rnd.randrange(1, 400)))
    groups = packing.BinGroups.best_fit(counts, 64)
    groups.search(300)
    groups.shake(rnd)
    seen, fill = Counter(), Counter()
    for length, first, end, sequence, offset in groups.plan():
        assert first == seen[length]
        seen[length] += end - first
        for k in range(end - first):
            assert fill[sequence + k] == offset
            fill[sequence + k] += length
    assert seen == counts and max(fill.values()) <= 64


def brute_cost(supply, capacity, cost):
    """Cheapest assignment of unit supplies by enumeration."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    best = None
    for places in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(places.count(j) <= c for j, c in enumerate(capacity)):
            total = sum(cost(i, j) for i, j in zip(units, places, strict=True))
            best = total if best is None else min(best, total)
    return best


def test_flow_is_cheapest():
    rnd = random.Random(1)
    for _ in range(60):
        supply, capacity = [rnd.randrange(3) for _ in range(3)], [rnd.randrange(1, 4) for _ in range(3)]
        if sum(supply) > sum(capacity):
            continue
        prices = [[0 if i == j and rnd.random() < 0.7 else rnd.randrange(6) for j in range(3)] for i in range(3)]
        cost = lambda i, j, prices=prices: prices[i][j]
        flow = resharding.minimum_cost_flow(supply, capacity, cost)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(3)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(3))
        assert sum(v * cost(*e) for e, v in flow.items()) == brute_cost(supply, capacity, cost)
    with pytest.raises(ValueError):
        resharding.minimum_cost_flow([5], [4], lambda i, j: 1)


def test_plain_price_has_a_closed_form():
    rnd = random.Random(2)
    for _ in range(60):
        supply, n = [rnd.randrange(4) for _ in range(4)], rnd.randrange(1, 6)
        capacity = resharding.even_capacities(sum(supply) + rnd.randrange(3), n)
        plain = lambda i, j: int(i != j)
        flow = resharding.cheapest_moves(supply, capacity, [k if k < n else None for k in range(4)])
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(4)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(n))
        assert sum(v * plain(*e) for e, v in flow.items()) == sum(v * plain(*e) for e, v in resharding.minimum_cost_flow(supply, capacity, plain).items())


def test_flow_of_many_shards():
    rnd = random.Random(4)
    supply = [rnd.randrange(10**12) for _ in range(300)]
    capacity = resharding.even_capacities(sum(supply), 310)
    cost = lambda i, j: 0 if i == j else 1 + (i // 20 != j // 20) * 3
    flow = resharding.minimum_cost_flow(supply, capacity, cost)
    assert sum(flow.values()) == sum(supply) and all(v > 0 for v in flow.values())
    assert sum(v for e, v in flow.items() if cost(*e)) == sum(max(0, s - c) for s, c in zip(supply, capacity, strict=False))


def test_rewrite_in_place_keeps_unaffected_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    texts = {0: "x" * 9, 1: "y" * 4, 2: "z" * 4, 3: ""}
    rows = [(10 * s + k if k else None, texts[s] if s else None if k == 5 else texts[0], 7.5, s) for s in texts for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, _rank double, shard int").write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    before = {f: f.stat().st_mtime_ns for s in (1, 2) for f in (tmp_path / "shards" / f"shard={s}").iterdir()}
    plan = resharding.reshard(docs, F.col("shard"), [60, 50, 50, 50])
    plan = resharding.written(plan, "plan")
    found = {r["shard"]: r["bytes_in"] for r in resharding.rewrite_affected(docs, plan, path).collect()}
    assert set(found) == {0, 3} and found[0] == 0 < found[3]
    after = spark.read.parquet(path)
    assert Counter(map(tuple, after.select("doc_id", "text", "_rank").collect())) == Counter(r[:3] for r in rows)
    assert {f: f.stat().st_mtime_ns for f in before} == before
    sizes = {r["shard"]: r["n"] for r in plan.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert {r["shard"]: r["count"] for r in after.groupBy("shard").count().collect()} == sizes
    emptied = resharding.written(resharding.reshard(after, F.col("shard"), [10**6, 0, 0, 0], cost=lambda i, j: int(j != 0)), "plan")
    resharding.rewrite_affected(after, emptied, path)
    again = spark.read.parquet(path)
    assert {r["shard"]: r["count"] for r in again.groupBy("shard").count().collect()} == {0: 40}
    assert sorted(r["slot"] for r in again.collect()) == list(range(40))


def test_rewrite_refuses_to_lose_rows(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(k, "t" * k, k % 4) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    for seen, changed in ((docs.where("doc_id < 30"), docs), (docs, docs.where("doc_id < 30"))):
        plan = resharding.written(resharding.reshard(seen, F.col("shard"), 5), "plan")
        with pytest.raises(ValueError, match="10 of the assignment|10 rows are not"):
            resharding.rewrite_affected(changed, plan, path)
    assert sorted(map(tuple, spark.read.parquet(path).select("doc_id", "text", "shard").collect())) == rows


def test_resharding_of_long_texts(spark):
    docs = spark.createDataFrame([(k, "w" * (3_000_000 if k == 3 else k)) for k in range(40)], "doc_id long, text string")
    got = resharding.reshard(docs, F.lit(1), 3).collect()
    assert len(got) == 40 and sum(r["size"] for r in got) == sum((3_000_000 if k == 3 else k) + 1 for k in range(40))


def test_resharding(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, "é" * rnd.randrange(300) if k % 17 else None, 5) for k in range(700)] + [(None, "x", 5), (3, "same", 5), (3, "same", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    placed = resharding.reshard(docs, F.col("doc_id") % 5, 8)
    got = placed.collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, _ in rows)
    by, slots = Counter(), defaultdict(list)
    for r in got:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) < 2 * 600, by
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    old = Counter()
    for r in got:
        old[r["old_shard"]] += r["size"]
    total = sum(old.values())
    least = sum(max(0, old[k] - -(-total // 8)) for k in old)
    moved = sum(r["size"] for r in got if r["old_shard"] != r["shard"])
    assert least <= moved <= least + 600 * len(old)
    assert resharding.reshard(docs.limit(0), F.lit(0), 8).count() == 0
    unique = docs.where("doc_id > 3")
    again = resharding.reshard(unique, F.col("doc_id") % 8, [10**9] * 8)
    assert again.where("old_shard != shard").count() == 0
    assert resharding.rewrite_affected(unique, again, str(tmp_path / "none")).count() == 0
    plan = resharding.reshard(unique, F.lit(0), 2)
    written = resharding.rewrite_affected(unique.drop("shard"), plan, str(tmp_path / "some"))
    assert {r["shard"]: r["bytes_in"] > 0 for r in written.collect()} == {0: False, 1: True}
    assert spark.read.parquet(str(tmp_path / "some")).count() == unique.count()


def test_a_worker_keeps_its_words_between_tasks(monkeypatch):
    texts = [b"several words, some twice: words", b"and others"]
    packing._encoder.cache_clear()
    first = list(packing._encoder(None).ids(texts))
    asked = []
    monkeypatch.setattr(packing.WordEncoder, "_encode", lambda self, words: asked.extend(words))
    assert list(packing._encoder(None).ids(texts)) == first and not asked
