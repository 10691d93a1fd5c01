"""Secret scan: high-recall candidates and a random forest that removes false positives.

Candidates are matches of known token formats, values assigned to names that
sound like credentials, and runs of 16 or more key characters with a digit
(hashes, identifiers and long numbers among them). The forest is trained from
labelled findings on length, character transitions, entropy, dictionary
coverage, path and neighbouring words (those within 60 bytes before the
candidate); the dictionary is the most frequent words of the corpus itself.

Defined results: null and empty texts have no candidates; a null id stays null;
repeated rows are scanned each; an empty table gives an empty result; without a
path column the path features are 0; of overlapping candidates the first rule's
stays, of one rule the leftmost; words of equal count enter the dictionary in
alphabetical order; other columns are not read. Offsets count code points, end
exclusive.
"""

from __future__ import annotations

import bisect
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tokens import ALNUM, scan_column, text_slices

#: Formats that services publish for their tokens.
FORMATS = {
    "aws_key_id": rb"AKIA[0-9A-Z]{16}",
    "github_token": rb"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": rb"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": rb"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "private_key": rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
_NAMES = rb"token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth|credential"
_ASSIGNED = re.compile(rb"(?i)(?:" + _NAMES + rb")[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,})")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_FORMAT = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), v) for k, v in FORMATS.items()))
_CUE = re.compile(rb"(?i)(?<![a-z])(?:" + _NAMES + rb"|key|private|bearer)(?![a-z])")
_HARMLESS = re.compile(rb"(?i)\b(?:sha\d*|md5|hash|checksum|digest|commit|revision|uuid|guid|id|etag|example|sample|dummy|placeholder|version|isbn|image|data)\b")
_TEST_PATH = re.compile(r"(?i)test|example|sample|mock|fixture|doc|vendor|\.lock|\.sum|\.svg|\.min\.")
_CONFIG_PATH = re.compile(r"(?i)\.env|config|settings|\.ya?ml|\.toml|\.ini|\.properties|\.pem|deploy")

FEATURES = ("length", "transitions", "entropy", "digits", "upper", "letters_only_hex", "dictionary", "distinct", "cue", "harmless", "quoted", "assigned", "format", "test_path", "config_path")
#: Words of the dictionary: the most frequent of the corpus.
LEXICON_WORDS = 20_000
#: Labelled findings generated for training where none are given.
LABELLED_FINDINGS = 3000
TREES, DEPTH, THRESHOLD = 40, 8, 0.5

_CLASS = np.full(256, 3, np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 0, 1, 2


def find(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the candidates of a text, in bytes; of candidates that overlap, the first rule's stays."""
    out: list[tuple[int, int, str]] = []
    out += [(*m.span(), m.lastgroup) for m in _FORMAT.finditer(text)]
    out += [(*m.span(1), "assigned") for m in _ASSIGNED.finditer(text)]
    out += [(*m.span(), "run") for m in _RUN.finditer(text) if any(0x30 <= c <= 0x39 for c in m[0])]
    if len(out) < 2:
        return out
    rank = {r: k for k, r in enumerate((*FORMATS, "assigned", "run"))}
    out.sort(key=lambda c: (c[0], rank[c[2]]))
    kept, run, reach = [], [], -1
    for c in [*out, (1 << 62, 1 << 62, "run")]:
        if run and c[0] >= reach:
            best: list[tuple[int, int, str]] = []
            for x in sorted(run, key=lambda c: (rank[c[2]], c[0])):
                k = bisect.bisect_left(best, x)
                if (k == 0 or best[k - 1][1] <= x[0]) and (k == len(best) or x[1] <= best[k][0]):
                    best.insert(k, x)
            kept += best
            run, reach = [], -1
        run.append(c)
        reach = max(reach, c[1])
    return kept


def features(value: bytes, before: bytes, path: str | None, rule: str, lexicon: frozenset) -> list[float]:
    codes = np.frombuffer(value, np.uint8)
    kind = _CLASS[codes]
    n = len(codes)
    share = np.bincount(codes, minlength=256)
    p = share[share > 0] / n
    low, at, known = value.lower(), 0, 0
    while at < n:
        for size in range(min(12, n - at), 2, -1):
            if low[at : at + size] in lexicon:
                known, at = known + size, at + size
                break
        else:
            at += 1
    cues = [m.end() for m in _CUE.finditer(before)]
    harmless = [m.end() for m in _HARMLESS.finditer(before)]
    return [
        float(min(n, 512)), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, float(-(p * np.log2(p)).sum()),
        float((kind == 0).mean()), float((kind == 1).mean()), float(all(c in b"0123456789abcdef" for c in low)), known / n, len(p) / n,
        1 / (1 + len(before) - cues[-1]) if cues else 0.0, 1 / (1 + len(before) - harmless[-1]) if harmless else 0.0,
        float(before[-1:] in (b'"', b"'", b"`")), float(rule == "assigned"), float(rule in FORMATS),
        float(bool(path and _TEST_PATH.search(path))), float(bool(path and _CONFIG_PATH.search(path))),
    ]


def lexicon(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> frozenset:
    """The most frequent words of 3 to 12 letters of the corpus; batches report all their words, Spark sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for _, _, w in scan_column(batch.column(0), ALNUM, lower=True):
                size = w.end - w.start
                ok = np.flatnonzero((size >= 3) & (size <= 12))
                _, first, n = np.unique(w.hashes[ok], return_index=True, return_counts=True)
                for i, c in zip(ok[first].tolist(), n.tolist(), strict=True):
                    total[w.data[w.start[i] : w.end[i]].tobytes()] += c
            rows = [(k, v) for k, v in total.items() if k.isalpha()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.int64())], names=["word", "n"])

    counts = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(words).collect())


def labelled_findings(lex: frozenset, n: int = LABELLED_FINDINGS, seed: int = 17) -> list[tuple[bytes, bytes, str, str, int]]:
    """Generated findings (value, text before, path, rule, label) of kinds whose truth is known by construction."""
    rnd = random.Random(seed)
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = sorted(w.decode() for w in lex)[:: max(1, len(lex) // 2000)] or ["lorem", "ipsum", "dolor"]
    draw = lambda chars, a, b: "".join(rnd.choice(chars) for _ in range(rnd.randint(a, b)))
    phrase = lambda sep: sep.join(rnd.choice(words) for _ in range(rnd.randint(3, 6)))
    prose = lambda: phrase(" ") + " "
    paths = {1: ["deploy/.env", "config/settings.py", "app.yaml", ""], 0: ["test/data.json", "package.lock", "docs/example.md", ""]}

    def cased(text: str) -> str:
        return rnd.choice([str, str, str.upper])(text)

    def one() -> tuple[str, str, str, int]:
        truth = rnd.random() < 0.5
        if truth:
            value = rnd.choice([lambda: draw(hexa, 32, 64), lambda: draw(b64, 20, 64), lambda: "ghp_" + draw(b64[:62], 36, 36), lambda: "AKIA" + draw(b64[:26] + "0123456789", 16, 16), lambda: "sk_live_" + draw(b64[:62], 24, 24)])()
            if value[:4] in ("ghp_", "AKIA", "sk_l") and rnd.random() < 0.5:  # known formats are secrets wherever they stand
                return value, prose() + rnd.choice(["", "", "id ", "the ", "key ", "version "]), "run", 1
            name = rnd.choice(["", "", "app_", "client-", "my.", "x_"]) + rnd.choice(["token", "secret", "password", "api_key", "access_key", "auth", "credential"])
            return cased(value) if value[:4] not in ("ghp_", "AKIA", "sk_l") else value, cased(prose() + name + rnd.choice([' = "', ": ", "='", '": "', "="])), "assigned", 1
        case = rnd.randrange(7)
        if case == 0:
            return draw(hexa, 40, 64), prose() + rnd.choice(["commit ", "sha256:", "md5 ", "checksum: ", 'etag = "', "digest "]), "run", 0
        if case == 1:
            return "-".join(draw(hexa, k, k) for k in (8, 4, 4, 4, 12)), prose() + rnd.choice(["uuid ", "id: ", ""]), "run", 0
        if case == 2:
            return phrase(rnd.choice(["-", "_", "/"])) + draw("0123456789", 1, 4), prose(), "run", 0
        if case == 3:
            return rnd.choice(["your-api-key-here", "changeme123456789", "xxxxxxxxxxxxxxxx", "REPLACE_WITH_TOKEN_1", "0000000000000000"]), prose() + rnd.choice(['token = "', "password: ", 'example key = "']), "assigned", 0
        if case == 6:
            return rnd.choice(["", "img-", "ref_"]) + draw(hexa, 16, 40), prose() + rnd.choice(["revision ", "hash ", "guid ", "file ", "checksum ", "build "]), "run", 0
        if case == 4:
            return draw("0123456789", 12, 30), prose(), "run", 0
        return phrase("_"), prose() + rnd.choice(["token = ", "auth: "]), "assigned", 0

    out = []
    for _ in range(n):
        value, before, rule, label = one()
        path = rnd.choice(paths[label] if rnd.random() < 0.5 else paths[0] + paths[1])
        raw = value.encode()
        rule = m.lastgroup if (m := _FORMAT.match(raw)) else rule
        out.append((raw, before.encode()[-60:], path, rule, label))
    return out


def train_forest(spark: SparkSession, lex: frozenset, findings: list[tuple[bytes, bytes, str, str, int]] | None = None, seed: int = 17):
    """A random forest of Spark ML over the findings' features."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    rows = [(float(label), Vectors.dense(features(value, before, path, rule, lex))) for value, before, path, rule, label in findings or labelled_findings(lex, seed=seed)]
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(table)


def scan_secrets(docs: DataFrame, model=None, lex: frozenset | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate: ``(doc_id, start, end, rule, score, is_secret)``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = docs.sparkSession
    lex = lexicon(docs, text_col) if lex is None else lex
    model = train_forest(spark, lex) if model is None else model
    shared = spark.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            row, start, end, rules, values = [], [], [], [], []
            for first, stop, data, at in text_slices(batch.column(1)):
                paths = batch.column(2).slice(first, stop - first).to_pylist()
                for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    text, done, chars = data[a:b].tobytes(), 0, 0
                    for x, y, rule in find(text):
                        chars += len(text[done:x].decode(errors="replace"))
                        done = x
                        row.append(first + r)
                        start.append(chars)
                        end.append(chars + y - x)
                        rules.append(rule)
                        values.append(features(text[x:y], text[max(0, x - 60) : x], paths[r], rule, words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(rules, pa.string()), pa.array(values, pa.list_(pa.float64()))],
                names=["doc_id", "start", "end", "rule", "values"],
            )

    path = F.lit(None).cast("string") if path_col is None else F.col(path_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))
    found = slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, start long, end long, rule string, values array<double>")
    scored = model.transform(found.withColumn("features", array_to_vector("values")))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("doc_id", "start", "end", "rule", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))
