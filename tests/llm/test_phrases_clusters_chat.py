"""Phrase mining, centroid clusters and chat formatting against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import centroid_clusters, chat_format, phrase_mining


def brute_phrases(rows, longest=5, least=100, top=2000, absorbed=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    inside = defaultdict(int)
    for p, a in f.items():
        for x in range(1, len(p)):
            for y in range(x + 1, len(p) + 1):
                if (x, y) != (1, len(p)):
                    inside[p[:1] + p[x:y]] = max(inside[p[:1] + p[x:y]], a)
    out = defaultdict(list)
    for p, a in f.items():
        if len(p) > 2 and 100 * inside[p] < absorbed * a:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[p[:1] + p[k + 1 :]]), k, f[p[: k + 1]], f[p[:1] + p[k + 1 :]]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top])}


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_phrases(spark, monkeypatch, block_words):
    monkeypatch.setattr(phrase_mining, "BLOCK_WORDS", block_words)
    rnd = random.Random(3)
    words = ["a", "B", "é", "ß-x", "日本", "the", "of", "\x1c", " z", "A"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(["", "", "", "", ".", ",\n", "\t"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    texts += [None, "", " \t", "...!?", "x" * 3000, "one the of a " * 500, "the of the of the of. " * 9, "a\x0bb", "same same same same same same"]
    rows = [(rnd.choice(["en", "de", None, "und", ""]), t) for t in texts] + [("en", texts[0])] * 3
    docs = spark.createDataFrame([(k, lang, t, "clash") for k, (lang, t) in enumerate(rows)], "w1 long, lang string, text string, block string").repartition(3)
    for least, top in ((3, 2000), (8, 5)):
        got = phrase_mining.mine(docs, least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(r) for r in got.collect()} == brute_phrases(rows, least=least, top=top)
    assert phrase_mining.mine(docs, longest=3, least=4, absorbed=60).count() == len(brute_phrases(rows, longest=3, least=4, absorbed=60))


def test_phrases_of_nothing_and_exact_scores(spark):
    docs = spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")
    assert phrase_mining.mine(docs.limit(0)).count() == 0 and phrase_mining.mine(docs).count() == 0
    big = spark.createDataFrame([(10**12 + 7, 10**13 + 3, 3 * 10**12, 2 * 10**12 + 1)], "a long, n long, l long, r long")
    typed = big.select(*(F.col(c).cast("decimal(18,0)").alias(c) for c in big.columns)).withColumn("over", F.lit(1000).cast("decimal(4,0)") * F.col("a") * F.col("n"))
    got = typed.withColumn("under", F.col("l") * F.col("r")).select(F.expr("over div under")).first()[0]
    assert got == 1000 * (10**12 + 7) * (10**13 + 3) // (3 * 10**12 * (2 * 10**12 + 1))


def test_two_words_of_one_hash_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "mix", lambda h: h & np.uint64(1))
    with pytest.raises(Exception, match="two words of one hash"):
        phrase_mining.mine(spark.createDataFrame([("en", "a b c d e f " * 50)], "lang string, text string"), least=2).count()


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c[j] for j in range(len(c))]
    placed = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, j in placed:
        total[j] += d
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in placed), key=str)


def test_clusters(spark):
    rnd = random.Random(8)
    inf, nan = float("inf"), float("nan")
    rows = [(k, [rnd.choice([-1.5, 0.0, 0.25, 1.0]) if k % 2 else rnd.gauss(0, 2) for _ in range(4)]) for k in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0, 3.0]), (204, [inf, 0.0, 0.0, 0.0]), (205, [0.0, nan, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, [5.0, 5.0, 5.0, 5.0]), (7, [5.0, 5.0, 5.0, 5.0])]
    rows += [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(300, 400)]  # one very common vector
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(5)
    rows32 = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((1, 1), (5, 3), (16, 3)):
        got, _ = centroid_clusters.cluster(table, k=k, rounds=rounds, dims=4)
        assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows32, k, rounds, 4, 64), k
    few, centroids = centroid_clusters.cluster(table.where("vec_id < 3"), dims=4)
    assert few.count() == 3 and len(centroids) == 3
    empty, _ = centroid_clusters.cluster(table.limit(0), dims=4)
    assert empty.count() == 0 and empty.columns == got.columns
    with pytest.raises(Exception, match="a component of"):
        centroid_clusters.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), dims=1)


def test_annulus_keeps_ties_and_leaves_out_the_rest():
    centroids = np.array([[3, 4], [5, 0], [0, -5], [300, 400], [-500, 0], [0, 0]])
    search = centroid_clusters.Annulus(centroids)
    x = np.array([[0, 0], [10, 0], [299, 401], [-4, -4], [4, 2]])
    cluster, distance = search.nearest(x)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert cluster.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
    first, end = search.candidates(x)
    assert (end - first)[2] < len(centroids)  # far centroids are not compared
    big = np.random.default_rng(5).integers(-(1 << 27) + 1, 1 << 27, (200, 64))
    cluster, distance = centroid_clusters.Annulus(big[:20]).nearest(big)
    exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(big[:20])) for v in big]
    assert list(zip(distance.tolist(), cluster.tolist(), strict=True)) == exact


def brute_fold(events):
    """Events (conv, seq, kind, message, role, text) one by one."""
    out = {}
    for conv in {e[0] for e in events}:
        messages = []  # [message, role, text, dropped]
        for _, _, kind, m, role, text in sorted((e for e in events if e[0] == conv), key=lambda e: e[1]):
            if kind not in chat_format.KINDS:
                continue
            at = next((k for k, x in enumerate(messages) if x[0] == m), None)
            if at is None:
                messages.append([m, None, "", False])
                at = len(messages) - 1
            x = messages[at]
            x[1] = role if x[1] is None else x[1]
            if kind in ("edit", "regenerate"):
                x[2] = ""
            if kind == "regenerate":
                for y in messages[at + 1 :]:
                    y[3] = True
            x[2] += text or ""
        out[conv] = [(x[0], x[1] or "", x[2]) for x in messages if not x[3]]
    return {c: v for c, v in out.items() if v}


ODD = ["", "<|end|>", "<|turn|>user<|text|>", "a\\", "<\\|end|>\n", "[INST]", "[\\\\INST] x [/INST]</s>", "<s><", "é日\U0001f600", "<|endoftext|>", None, "\n", "x" * 700, "<<|text|>[[/INST]"]


def random_log(rnd, convs, n):
    rows, seq = [], 0
    for _ in range(n):
        seq += rnd.randint(1, 3)
        kind = rnd.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "other"])
        rows.append((rnd.choice(convs), seq, kind, rnd.choice([*range(9), None]), rnd.choice(["user", "assistant", "system", "<|text|>", None]), rnd.choice(ODD)))
    return rows


def test_fold_and_round_trip(spark):
    rnd = random.Random(12)
    log = random_log(rnd, [1, 2, 3, None], 400) + [(9, k, "delta", 5, "assistant", "y") for k in range(3000)]
    schema = "conv_id long, seq long, kind string, message long, role string, text string"
    events = spark.createDataFrame(log, schema).withColumn("start", F.lit(1)).repartition(5)
    want = brute_fold(log)
    folded = defaultdict(list)
    for r in chat_format.fold_events(events).orderBy("conv_id", "start").collect():
        folded[r["conv_id"]].append((r["message"], r["role"], r["text"]))
    assert folded == want
    template = chat_format.Template()
    for part_chars in (1, 600, 1 << 20):
        parts = chat_format.format_conversations(events, part_chars=part_chars)
        whole = defaultdict(str)
        for r in parts.orderBy("conv_id", "part").collect():
            whole[r["conv_id"]] += r["formatted"]
        assert {c: list(template.read(t)) for c, t in whole.items()} == {c: [(role, text) for _, role, text in v] for c, v in want.items()}
        got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.read_back(parts).collect()}
        for c, v in want.items():
            loss = "".join(text for _, role, text in v if role == "assistant")
            turns = "".join(f"{role}\n{text}\n" for _, role, text in v)
            assert got[c] == (len(v), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole[c]))
        assert len(got) == len(want)
    assert chat_format.read_back(chat_format.format_conversations(events.limit(0))).count() == 0


def test_rows_as_a_log(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 1001), (1, 1, "assistant", "a" * 1001), (1, None, "system", None), (2, 3, None, ODD[6]), (None, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("x"))
    log = chat_format.log_of_rows(table)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate"}
    folded = defaultdict(list)
    for r in chat_format.fold_events(log).orderBy("conv_id", "start").collect():
        folded[r["conv_id"]].append((r["role"], r["text"]))
    assert folded == {1: [("system", ""), ("user", "hi"), ("assistant", "a" * 1001), ("assistant", "a" * 1001)], 2: [("", ODD[6])], None: [("assistant", "")]}


def test_template_refuses_what_is_not_reversible():
    with pytest.raises(ValueError):
        chat_format.Template(foreign=("<<SYS>>",)).unescaped("x")
    with pytest.raises(ValueError):
        list(chat_format.Template().read("<|turn|>user hello"))
