"""The pipeline's stages against brute force on a small fixture."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline
from marlstone.llm import packing
from tests.llm.test_rules_and_spans import brute_spans
from tests.llm.test_words import brute_components, brute_hits, brute_measures, brute_sets


def corpus():
    rnd = random.Random(21)
    vocabulary = [f"wo{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(15))) for k in range(4)]
    texts = []
    for k in range(24):
        ws = [rnd.choice(vocabulary) for _ in range(90)]
        if k % 6 == 1:
            ws[20:20] = items[k % 4][1].split()
        if k % 5 == 2:
            ws[40:40] = ["mail", "some.one@host.org", "4111", "1111", "1111", "1111"]
        texts.append(" ".join(ws))
        if k % 4 == 0:
            texts.append(" ".join([*ws[:-2], "changed"]))
        if k % 8 == 0:
            texts.append(" ".join(ws))
    texts += ["short one", None, "again and " * 60, items[0][1] + " tail", "### " * 80, items[1][1] + " " + " ".join(items[2][1].split() * 3) + " " + " ".join(vocabulary[:12])]
    return items, texts


def test_stages(spark, tmp_path):
    items, texts = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(2 * k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = {}
    for i, t, *_ in rows:
        m = brute_measures(t)
        if not (m[0] < 50 or 100 * m[5] > 50 * m[0] or 10 * m[2] > 3 * m[0] or 2 * m[4] > m[3] or m[1] < 2 * m[0] or m[1] > 20 * m[0]):
            expected[i] = t
    docs = corpus_pipeline.read_table(spark, str(tmp_path), "documents")
    states = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = corpus_pipeline.written(docs, name)
        states.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert states[0] == expected
    ids = sorted(expected)
    components = brute_components(ids, brute_sets([expected[i] for i in ids], 5), Fraction(4, 5))
    assert states[1] == {i: expected[i] for i in ids if components[i] == i}
    for i, t in states[1].items():
        n, hit, _ = brute_hits(t, items, 10)
        if 2 * hit >= n:
            assert i not in states[2]
        else:
            assert brute_hits(states[2][i], items, 10)[1] == 0 and (hit or states[2][i] == t)
    for i, t in states[2].items():
        spans = [s.split(":") for s in brute_spans(t).split(",") if s]
        assert set(states[3]) == set(states[2]) and (spans or states[3][i] == t or "[" in states[3][i])
        assert not any(t[int(a) : int(b)] in states[3][i] for _, a, b in spans)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    whole, pieces = packing._tokenizer(None), Counter()
    for i, t in states[3].items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        pieces[(i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))] += 1
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    fill = defaultdict(int)
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    direct = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in direct) == Counter((r["doc_id"], r["ids_crc32"]) for r in packed)
    assert all(re.fullmatch("[a-z_]+", name) for name, _ in corpus_pipeline.STAGES)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, columns with the names that the stages use, a very long text, and an empty table."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9)))
    plain = [" ".join(word() for _ in range(80)) for _ in range(6)]
    long = " ".join(word() for _ in range(60_000)) + " mail some.one@host.org"
    schema = "doc_id long, text string, _row string, _id int, _key string, _new string, component double"
    more = ("r", 1, "k", "n", 0.5)
    rows = [(1, plain[0], *more), (1, plain[0], *more), (1, plain[1], *more), (None, plain[2], *more), (None, plain[2], *more), (None, None, *more), (5, long, *more), (6, plain[3], None, None, None, None, None), (7, "", *more)]
    spark.createDataFrame([(0, plain[3][:40])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == ["doc_id", "text", "_row", "_id", "_key", "_new", "component"], name
        got = docs.collect()
        if given:
            assert Counter(r["doc_id"] for r in got) == Counter([1, None, 5, 6])
            assert next(r["text"] for r in got if r["doc_id"] == 5) == long.replace("some.one@host.org", "[email]")
            assert all(tuple(r)[2:] == (more if r["doc_id"] != 6 else (None,) * 5) for r in got)
        else:
            assert got == []
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in got}
