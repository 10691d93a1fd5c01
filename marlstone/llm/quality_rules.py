"""Rule bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one failure bit a rule; policies are named, versioned bit
masks that are applied to the ledger afterwards, and ablations of a policy are
counts over the failure bits.

Defined results: a null or empty text has no words and all counts 0, so it
fails ``too_few_words``; a null id stays null; repeated rows are judged each by
itself; an empty table gives an empty ledger; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import NOT_SPACE, Words, byte_class, scan_column

SYMBOLS = byte_class(b"#*$%&|<>")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule name -> failure test over the measures, in integers so that every engine agrees. Bit k belongs to the k-th rule.
RULES = {
    "too_few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbol_heavy": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "duplicate_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def mask(*rules: str) -> int:
    return sum(BIT[r] for r in set(rules))


#: Policy (name, version) -> the rules that it enforces.
POLICIES = {
    ("base", 1): mask("too_few_words", "repeated_windows"),
    ("web", 1): mask("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines"),
    ("web", 2): mask(*RULES),
}
DEFAULT_POLICY = ("web", 2)

LEDGER_SCHEMA = ", ".join(f"{m} long" for m in MEASURES) + ", failure_bits long"


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(words: Words, k: int = 3) -> np.ndarray:
    """Words inside a window of k words that occurs twice or more in its document."""
    covered = np.zeros(len(words.hashes), bool)
    at, h = words.windows(k)
    if len(at):
        h = h + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        for j in range(k):
            covered[twice + j] = True
    return _per_doc(covered, words.first)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of the document."""
    n, dup = np.zeros((2, len(words.doc_start) - 1), np.int64)
    raw = words.data.tobytes()
    for d, (a, b) in enumerate(zip(words.doc_start[:-1].tolist(), words.doc_start[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        n[d], dup[d] = len(lines), len(lines) - len(set(lines))
    return n, dup


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of an Arrow string column."""
    parts: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    for _, _, w in scan_column(column, NOT_SPACE):
        n_lines, n_dup = _lines(w)
        found = {
            "n_words": np.diff(w.first),
            "word_chars": _per_doc(NOT_SPACE[w.data] & ((w.data & 0xC0) != 0x80), w.doc_start),
            "n_symbols": _per_doc(SYMBOLS[w.data], w.doc_start),
            "n_lines": n_lines,
            "n_dup_lines": n_dup,
            "n_repeat_words": _repeated(w),
        }
        for m in MEASURES:
            parts[m].append(found[m])
    out = {m: np.concatenate(v) if v else np.zeros(0, np.int64) for m, v in parts.items()}
    bits = np.zeros(len(out["n_words"]), np.int64)
    for name, fails in RULES.items():
        bits |= np.where(fails(out), BIT[name], 0)
    return out | {"failure_bits": bits}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id, the measures and ``failure_bits``. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in found.values())], names=[id_col, *found])

    slim = docs.select(id_col, text_col)
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, {LEDGER_SCHEMA}")


def verdict(policy: tuple[str, int] = DEFAULT_POLICY, bits: str = "failure_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(POLICIES[policy]) == 0


def keep_documents(docs: DataFrame, policy: tuple[str, int] = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The documents, all columns unchanged, that pass the policy.

    Null and empty texts have no words and go under any policy that asks for
    some; ids are not read, repeated rows are judged each and columns may have any
    name; an empty table stays empty.
    """
    at, enforced = docs.columns.index(text_col), POLICIES[policy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(at))["failure_bits"] & enforced == 0))

    return docs.mapInArrow(run, docs.schema)


def ablations(ledger_df: DataFrame, policy: tuple[str, int] = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger shrinks to a count for each set of failure bits (at most 2 to
    the number of rules) before the rules are compared.
    """
    enforced = POLICIES[policy]
    sets = ledger_df.groupBy(F.col("failure_bits").bitwiseAND(enforced).alias("bits")).agg(F.count("*").alias("n"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    rules = [(name, bit) for name, bit in BIT.items() if enforced & bit]
    row = sets.agg(
        *(c for name, bit in rules for c in (count(F.col("bits").bitwiseAND(bit) != 0).alias(f"{name}_any"), count(F.col("bits") == bit).alias(f"{name}_only"))),
        count(F.col("bits") == 0).alias("kept"),
    )
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"{name}_any").alias("n_failed"), F.col(f"{name}_only").alias("n_failed_only"), (F.col("kept") + F.col(f"{name}_only")).alias("n_kept_without")) for name, _ in rules))
    return row.select(F.inline(each))
