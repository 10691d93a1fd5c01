"""Word scanning, quality ledger, decontamination and n-gram join against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import decontamination, ngram_join, quality_rules
from marlstone.llm.graph import connected_components
from marlstone.llm.tokens import ALNUM, NOT_SPACE, scan_column

SPACE, ALNUM_RE = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = [None, "", " ", "\n\n", "a", "a b", "éé ñ 日本 x", "x" * 5000, "a\x1cb\x85c  d", "Same line\nSame line\nother", "1 2 3 " * 400]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(column, keep, low):
    out = []
    for _, _, w in scan_column(column, keep, low):
        out += [[w.text(i, 1).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=12))
def test_words_equal_regular_expressions(texts):
    column = pa.array(texts, pa.string())
    assert words_of(column, NOT_SPACE, False) == [re.findall(SPACE, t or "") for t in texts]
    assert words_of(column, ALNUM, True) == [re.findall(ALNUM_RE, lower(t)) for t in texts]
    assert words_of(column.slice(1), NOT_SPACE, False) == [re.findall(SPACE, t or "") for t in texts[1:]]


def test_hashes_depend_on_words_only():
    column = pa.array(["alpha beta gamma delta", "zz alpha beta", "beta gamma", "averyveryverylongword " * 2])
    (_, _, w), = scan_column(column)
    text = [w.text(i, 1) for i in range(len(w.hashes))]
    assert len({(t, h) for t, h in zip(text, w.hashes.tolist(), strict=True)}) == len(set(text))
    at, h = w.windows(2)
    pairs = [w.text(i, 2) for i in at]
    assert b"delta zz" not in pairs and len(set(h.tolist())) == len(set(pairs))


def brute_measures(t):
    t = t or ""
    ws, seen, cover = re.findall(SPACE, t), {}, set()
    for j in range(len(ws) - 2):
        seen.setdefault(tuple(ws[j : j + 3]), []).append(j)
    for at in seen.values():
        if len(at) > 1:
            cover |= {j + k for j in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(cover))


def test_ledger(spark):
    rnd = random.Random(3)
    texts = [*ODD, *(" ".join(rnd.choice("abc#|") for _ in range(rnd.randrange(120))) for _ in range(40))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, failure_bits string")
    rows = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    for k, t in enumerate(texts):
        m = brute_measures(t)
        assert tuple(rows[k][c] for c in quality_rules.MEASURES) == m
        fails = (m[0] < 50) * 1 + (100 * m[5] > 50 * m[0]) * 2 + (10 * m[2] > 3 * m[0]) * 4 + (2 * m[4] > m[3]) * 8 + (m[1] < 2 * m[0]) * 16 + (m[1] > 20 * m[0]) * 32
        assert rows[k]["failure_bits"] == fails
    kept = {r["doc_id"] for r in quality_rules.keep_documents(docs).collect()}
    assert kept == {k for k in rows if rows[k]["failure_bits"] == 0}
    bits = [r["failure_bits"] for r in rows.values()]
    for r in quality_rules.ablations(quality_rules.ledger(docs)).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_kept_without"] == sum(not b & ~bit for b in bits)
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_ledger_null_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in quality_rules.ledger(docs).collect()) == [(-1, 1), (1, 0), (1, 0)]


def brute_hits(text, items, n):
    ws, cover, found = re.findall(ALNUM_RE, lower(text)), set(), set()
    for item, t in items:
        iw = re.findall(ALNUM_RE, lower(t))
        k = min(n, len(iw))
        wins = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)} if k else set()
        for j in range(len(ws) - k + 1):
            if k and tuple(ws[j : j + k]) in wins:
                cover |= set(range(j, j + k))
                found.add(str(item))
    return len(ws), len(cover), sorted(found)


@pytest.fixture(scope="module")
def contaminated():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(rnd.choice([3, 7, 12, 30])))) for k in range(12)] + [(12, None), (13, "!!"), (14, "Éa-B"), (3, None)]
    texts = [*ODD, "x éA b y"]
    for k in range(30):
        ws = make(rnd.randrange(5, 60))
        if k % 2:
            at = rnd.randrange(len(ws))
            ws[at:at] = [w.upper() for w in items[k % 12][1].split()]
        texts.append(", ".join(ws))
    return items, texts


def test_decontamination(spark, contaminated):
    items, texts = contaminated
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.scan_documents(docs, bench, n=10).collect()}
    for k, t in enumerate(texts):
        assert (rows[k]["n_words"], rows[k]["n_hit"], rows[k]["items"]) == brute_hits(t, items, 10)
    left = decontamination.remove_contamination(docs, bench, n=10)
    assert left.columns == docs.columns
    for r in left.collect():
        assert brute_hits(r["text"], items, 10)[1] == 0
        if rows[r["doc_id"]]["n_hit"] == 0:
            assert r["text"] == texts[r["doc_id"]]
    gone = set(rows) - {r["doc_id"] for r in left.collect()}
    assert all(2 * rows[k]["n_hit"] >= rows[k]["n_words"] for k in gone)
    assert decontamination.scan_documents(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.scan_documents(docs.limit(0), bench).count() == 0
    assert len(decontamination.load_window_sets(bench, 10, max_windows=4)) > 1
    parts = decontamination.scan_documents(docs, bench, n=10, max_windows=4)
    assert sorted(map(str, parts.collect())) == sorted(map(str, rows.values()))
    assert all(brute_hits(r["text"], items, 10)[1] == 0 for r in decontamination.remove_contamination(docs, bench, n=10, max_windows=4).collect() if r["doc_id"] % 2 == 0)


def test_decontamination_in_parts_is_that_of_one_pass(spark, contaminated):
    items, texts = contaminated
    passage = [f"q{k}" for k in range(40)]
    items = [*items, (20, " ".join(passage[:12])), (21, " ".join(passage[5:17])), (22, " ".join(passage[20:32]))]
    texts = [*texts, " ".join([f"u{k}" for k in range(30)] + passage[:17]), " ".join(passage[:12] + [f"u{k}" for k in range(15)] + passage[20:32]), None]
    texts.append(" ".join([f"v{k}" for k in range(30)] + passage[:7] + passage[20:32] + passage[7:12]))
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, parts = (sorted(map(str, decontamination.remove_contamination(docs, bench, n=10, max_windows=m).collect())) for m in (2_000_000, 4))
    assert parts == one


def brute_sets(texts, n):
    out = []
    for t in texts:
        ws = re.findall(SPACE, lower(t))
        out.append({tuple(ws[j : j + n]) for j in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set()))
    return out


def brute_components(ids, sets, t):
    parent = {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (ids[a], ids[b]) and both and Fraction(both, len(sets[a] | sets[b])) >= t:
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def near_texts(seed, n_groups=14):
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    texts = list(ODD)
    for g in range(n_groups):
        base = [f"g{g}x{rnd.randrange(4000)}" for _ in range(rnd.choice([2, 5, 12, 40, 150]))]
        if g % 3 == 0:
            base = passage + base[:12]
        for _ in range(rnd.choice([1, 2, 6, 20])):
            ws = list(base)
            for _ in range(rnd.randrange(4)):
                ws[rnd.randrange(len(ws))] = f"e{rnd.randrange(9)}"
            texts.append(" ".join(ws).upper() if rnd.random() < 0.2 else "  ".join(ws))
    texts += [" ".join(passage + [f"u{k}z{j}" for j in range(k % 9)]) for k in range(60)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("n, t, seed", [(4, Fraction(85, 100), 1), (3, Fraction(1, 2), 3)])
def test_ngram_join(spark, monkeypatch, n, t, seed):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 3)
    texts = near_texts(seed)
    ids = [3 * k + 7 for k in range(len(texts))]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in zip(ids, texts, strict=True)], "doc_id long, text string, key int, rep int").repartition(3)
    members, links = ngram_join.ngram_jaccard_join(docs, n, t)
    rows = {r["doc_id"]: r for r in members.collect()}
    sets = brute_sets(texts, n)
    expected = brute_components(ids, sets, t)
    assert len(rows) == len(ids)
    for i, s in zip(ids, sets, strict=True):
        assert rows[i]["n_shingles"] == len(s) and rows[i]["component_id"] == expected[i]
    by_id = dict(zip(ids, sets, strict=True))
    for r in links.collect():
        a, b = by_id[r["a"]], by_id[r["b"]]
        assert (r["common"], r["total"]) == (len(a & b), len(a | b)) and Fraction(len(a & b), len(a | b)) >= t


def test_prefix_keys_meet_for_every_similar_pair():
    rnd, t = random.Random(11), Fraction(85, 100)
    for trial in range(300):
        size = rnd.randrange(2, 120)
        base = np.unique(np.array([rnd.getrandbits(64) for _ in range(size)], np.uint64))
        extra = np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(0, max(1, size // 6)) + 1)], np.uint64)
        gone = rnd.randrange(0, max(1, len(base) // 8))
        x, y = np.unique(np.concatenate([base, extra])), base[gone:]
        often = np.unique(np.concatenate([base[rnd.random() < 0.5 :], extra])) if trial % 3 else np.unique(base[:: rnd.randrange(1, 4)])
        levels = np.array([rnd.randrange(1, 4) for _ in often], np.uint8)
        both = len(np.intersect1d(x, y))
        if Fraction(both, len(np.union1d(x, y))) < t or len(x) == len(y) and (x == y).all():
            continue
        (kx, nx), (ky, ny) = (ngram_join.prefix_keys(z, t, ngram_join.token_levels(z, often, levels)) for z in (x, y))
        leading = ky[:ny] if len(y) <= len(x) else kx[:nx]
        other = kx if len(y) <= len(x) else ky
        met = np.intersect1d(leading, other)
        rx, ry = (ngram_join.reach(len(z), int(np.isin(z, often).sum()), t) for z in (x, y))
        assert any(len(x) <= ry[k] and len(y) <= rx[k] for k in (met & np.uint64(1)).astype(int))


def test_small_sets_of_frequent_tokens_meet_larger_ones():
    x, y = np.array([16, 32, 48, 64], np.uint64), np.array([16, 32], np.uint64)
    kx, _ = ngram_join.prefix_keys(x, Fraction(1, 2), np.ones(4, np.uint8))
    ky, ny = ngram_join.prefix_keys(y, Fraction(1, 2), np.ones(2, np.uint8))
    assert len(np.intersect1d(ky[:ny], kx))


def template_texts(counts, seed=5):
    """Texts of one 100-word template and some words of their own at the end."""
    rnd = random.Random(seed)
    template = " ".join(f"t{k}" for k in range(100))
    return [template + "".join(f" o{rnd.getrandbits(40)}" for _ in range(k)) for k in counts]


def test_template_documents_lead_by_rare_tokens_alone():
    t = Fraction(4, 5)
    sets = [next(ngram_join._sets_of(pa.array([x]), 5)) for x in template_texts([13] * 6)]
    often = np.unique(np.concatenate([np.intersect1d(sets[0], s) for s in sets[1:]]))
    levels = np.full(len(often), 2, np.uint8)
    keyed = [ngram_join.prefix_keys(s, t, ngram_join.token_levels(s, often, levels)) for s in sets]
    for a, (_, _) in enumerate(keyed):
        for keys, n_lead in keyed[:a]:
            assert not len(np.intersect1d(keys[:n_lead], keyed[a][0]))


def test_template_documents_of_all_lengths_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 7)
    texts = template_texts([k % 40 for k in range(160)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    members, links = ngram_join.ngram_jaccard_join(docs, 5, Fraction(4, 5))
    sets = brute_sets(texts, 5)
    expected = brute_components(list(range(len(texts))), sets, Fraction(4, 5))
    assert {r["doc_id"]: r["component_id"] for r in members.collect()} == expected
    for r in links.collect():
        assert (r["common"], r["total"]) == (len(sets[r["a"]] & sets[r["b"]]), len(sets[r["a"]] | sets[r["b"]]))


def test_join_of_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (None, text), (5, None), (5, "a b c d e f"), (9, "a b c d e f"), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, _ = ngram_join.ngram_jaccard_join(docs, 4, 0.85)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["component_id"] is None else r["component_id"]) for r in members.collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (5, 1), (5, 1), (5, 1), (9, 1)]
    members, links = ngram_join.ngram_jaccard_join(docs.limit(0))
    assert members.count() == 0 and links.count() == 0


def test_rows_of_one_id_and_of_none_are_joined_and_kept_once(spark):
    a, b = ([f"{x}{k}" for k in range(40)] for x in "ab")
    near = " ".join([*b[:-1], "other"])
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, near), (7, "x y"), (7, "x y"), (None, "p q r s t u"), (None, "p q r s t u"), (None, near), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    members, links = ngram_join.ngram_jaccard_join(docs, 5, 0.8)
    assert {(r["doc_id"], r["component_id"]) for r in members.collect()} == {(3, 3), (5, 3), (9, 3), (7, 7), (None, None)} and members.count() == len(rows)
    assert [(r["a"], r["b"], r["common"], r["total"]) for r in links.collect()] == [(9, 5, 35, 37)]
    left = ngram_join.keep_one_per_component(docs, 5, 0.8)
    assert left.columns == docs.columns
    got = sorted(r["k"] for r in left.collect())
    assert len(got) == 4 and got[0] == 0 and got[1] in (4, 5) and got[2] in (6, 7) and got[3] == 9


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(30)] + [(500, 500), (600, 601), (601, 600), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
