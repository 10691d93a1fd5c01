"""Personal data by candidate gradient boosting. DataFrame and SQL functions only.

Generators with high recall propose spans, which may overlap. The base kinds
have exact validators; candidates that these accept are always selected. Every
candidate also gets format and context features of few values. Boosted trees
are fitted on labelled findings whose truth is known by construction (data and
look-alikes in changing contexts, see :func:`labelled_findings`), not on what
the validators say; a threshold calibrated on held-out findings selects further
spans that no base rule accepts. The trees run as SQL expressions.

Labels: a candidate that overlaps the true span of its text and has its kind is
positive, every other one negative.

Defined results: a null text is empty and has no spans; a null id is a value
like others; repeated rows get a row each; an empty table gives an empty
result; of equally likely overlapping spans the longest, then the first is
taken; other columns, whatever their names, are kept by :func:`redact` and not
read. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import fresh, local_table, maybe_broadcast, written

#: The base kinds, and one that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

#: Generator -> (kind, pattern). Possessive groups keep the matcher from recursing; a look-behind keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email_spoken": ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z]++)++"),
    "email_words": ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++"),
    "ip_long": ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card_marked": ("card", r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    "phone_local": ("phone", r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "phone_trunk": ("phone", r"(?<![0-9.+-])\(?0[0-9]{1,4}\)?[\x20/-][0-9]{2,4}(?:[\x20/-]?[0-9]{2,4}){1,3}(?![0-9])"),
    "assigned": ("secret", r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_.=!-]{8,}+"),
    "key_id": ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|[rs]k_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"),
}
GENERATORS = {**{k: (k, p) for k, p in BASE.items()}, **MORE}
#: A part of a generator's pattern that is fast to look for: no match lacks it.
PARTS = {
    "email": "@", "email_spoken": r"(?i)[(\[{]at[)\]}]", "email_words": r"(?i)\x20at\x20[A-Za-z0-9-]+\x20dot\x20", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "phone_local": r"[0-9]{3}[\x20.-][0-9]{4}", "phone_trunk": r"0[0-9]{1,4}\)?[\x20/-][0-9]", "assigned": "[:=]", "key_id": "AKIA|gh[pousr]_|[rs]k_live_",
}

CUES = r"(?i)\b(?:e-?mails?|mail|write|contact|reach|phone|tel|mobile|call|dial|fax|card|visa|credit|account|pay|ip|host|server|address|login|user)\b[^\n]{0,12}$"
CODES = r"(?i)\b(?:hash|sha1|md5|checksum|version|commit|id|isbn|order|serial|invoice|part|build|example|sample|fingerprint|no|number|page)\b[^\n]{0,12}$"

#: Feature -> number of values.
FEATURES = {"gen": len(GENERATORS), "digits": 8, "groups": 5, "left": 6, "right": 6, "cue": 3, "luhn": 2, "few": 2, "mixed": 2}
#: Labelled findings that are generated for the fit, and of the trees: rounds, rate, least weight behind the threshold.
LABELLED_FINDINGS = 6000
ROUNDS, RATE, LEAF_WEIGHT = 60, 0.3, 5.0
#: Documents with spans whose lists may be broadcast.
LISTS_ROWS = 200_000
#: Code points of a stretch of text for the replacement of spans.
STRETCH = 4096
#: Share of right spans that the threshold must reach among the held-out labelled candidates.
PRECISION = 0.97


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", F.lit(0)).when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _accepted(gen: Column, match: Column, n: Column, luhn: Column) -> Column:
    """The validators of the base kinds."""
    octet = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}))"
    return (
        F.when(gen == "email", F.lit(True))
        .when(gen == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(gen == "card", n.between(12, 19) & luhn)
        .when(gen == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def _side(c: Column) -> Column:
    """Class of the character next to a candidate."""
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[\"'`=]$"), 2).when(c.rlike(r"^[\p{L}_]$"), 3).when(c.rlike("^[0-9]$"), 4).otherwise(5)


def _matches(text: Column, number: int, gen: str, kind: str, pattern: str) -> Column:
    """A generator's matches with the length and the ends of the gap before each; behind the last gap stands no match.

    Matches and gaps are found once a text and zipped, so the work is linear in
    the text and its matches.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def one(z: Column, i: Column) -> Column:
        return F.struct(
            F.lit(gen).alias("gen"), F.lit(number).alias("gen_no"), F.lit(kind).alias("kind"), i.alias("i"), z["match"].alias("match"),
            F.length(z["gap"]).alias("gap"), F.right(z["gap"], F.lit(40)).alias("before"), F.left(z["gap"], F.lit(1)).alias("first"),
        )

    return F.transform(zipped, one)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every proposed span: doc_id, text_key, gen, kind, start, end, accepted, and the features.

    ``text_key`` tells different texts of one id apart. Positions follow from
    the lengths of the gaps between a generator's matches, summed by a window
    over the document's own rows. Digit runs are cards from 12 to 19 digits.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    may = lambda gen, pattern: text.rlike(PARTS[gen]) & text.rlike(pattern) if gen in PARTS else text.rlike(pattern)
    found = [F.when(may(gen, pattern), _matches(text, k, gen, kind, pattern)) for k, (gen, (kind, pattern)) in enumerate(GENERATORS.items())]
    some = rows.select("doc_id", "text_key", F.explode(F.flatten(F.filter(F.array(*found), lambda a: a.isNotNull()))).alias("c")).select("doc_id", "text_key", "c.*")
    some = some.dropDuplicates(["doc_id", "text_key", "gen", "i"])
    order = Window.partitionBy("doc_id", "text_key", "gen").orderBy("i")
    length = F.length("match")
    end = F.sum((F.col("gap") + length).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    some = some.select("*", end.alias("end"), F.lead("first").over(order).alias("after")).where("match is not null")
    some = some.withColumn("start", F.col("end") - length).withColumn("number", _digits(F.col("match")))
    n = F.length("number")
    some = some.where((F.col("gen") != "card") | n.between(12, 19)).withColumn("luhn", n.between(12, 19) & _luhn(F.when(n.between(12, 19), F.col("number")).otherwise("")))
    digits = F.when(n == 0, 0).when(n < 9, 1).when(n == 9, 2).when(n < 12, 3).when(n < 15, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7)
    groups = F.least(F.size(F.regexp_extract_all("match", F.lit("[0-9]+"), F.lit(0))), F.lit(4))
    cue = F.when(F.col("before").rlike(CUES), 1).when(F.col("before").rlike(CODES), 2).otherwise(0)
    few = F.col("number").rlike("^([0-9])\\1*([0-9]?)(?:\\1|\\2)*$").cast("int")
    value = F.regexp_extract("match", "[A-Za-z0-9+/_.=!-]*$", 0)
    mixed = (value.rlike("[0-9]") & value.rlike("[A-Za-z]")).cast("int")
    return some.select(
        "doc_id", "text_key", "gen", "kind", "start", "end", _accepted(F.col("gen"), F.col("match"), n, F.col("luhn")).alias("accepted"), F.col("gen_no").alias("f_gen"), digits.alias("f_digits"), groups.alias("f_groups"),
        _side(F.right("before", F.lit(1))).alias("f_left"), _side(F.col("after")).alias("f_right"), cue.alias("f_cue"), F.col("luhn").cast("int").alias("f_luhn"), few.alias("f_few"), mixed.alias("f_mixed"),
    )


@dataclass
class Trees:
    """Depth-2 trees over the features, each (feature, value set, left leaf pair, right leaf pair), plus calibration and threshold."""

    trees: list
    a: float
    b: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (f, cut), *sides in self.trees:
            for side, (g, cut2, low, high) in zip((x[:, f] <= cut, x[:, f] > cut), sides, strict=True):
                total[side] += np.where(x[side][:, g] <= cut2, low, high)
        return total

    def probability(self) -> Column:
        """The calibrated probability as an expression over the feature columns."""
        column = [F.col(f"f_{name}") for name in FEATURES]
        total = F.lit(0.0)
        for (f, cut), (g, c1, l1, h1), (h, c2, l2, h2) in self.trees:
            total = total + F.when(column[f] <= cut, F.when(column[g] <= c1, l1).otherwise(h1)).otherwise(F.when(column[h] <= c2, l2).otherwise(h2))
        return 1 / (1 + F.exp(-(self.a * total + self.b)))


def _split(x, grad, hess, rows):
    """Best single split of some cells by the second-order gain."""
    best = (-1.0, 0, 0, 0.0, 0.0)
    leaf = lambda g, h: g / (h + 1.0)
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    for f, values in enumerate(FEATURES.values()):
        g = np.bincount(x[rows, f], grad[rows], values).cumsum()
        h = np.bincount(x[rows, f], hess[rows], values).cumsum()
        for cut in range(values - 1):
            gain = g[cut] * leaf(g[cut], h[cut]) + (total_g - g[cut]) * leaf(total_g - g[cut], total_h - h[cut])
            if gain > best[0] + 1e-12:
                best = (gain, f, cut, leaf(g[cut], h[cut]), leaf(total_g - g[cut], total_h - h[cut]))
    return best


def boost(x: np.ndarray, pos: np.ndarray, n: np.ndarray, cal_pos: np.ndarray, cal_n: np.ndarray) -> Trees:
    """Gradient boosting on weighted cells; the second counts calibrate the margin and set the threshold."""
    trees, margin = [], np.zeros(len(x))
    model = Trees(trees, 1.0, 0.0, 2.0)
    if not n.sum() or pos.sum() in (0, n.sum()) or not cal_n.sum():
        return model
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = pos - n * p, n * p * (1 - p)
        _, f, cut, *_ = _split(x, grad, hess, np.arange(len(x)))
        sides = []
        for rows in (np.flatnonzero(x[:, f] <= cut), np.flatnonzero(x[:, f] > cut)):
            _, g, c, low, high = _split(x, grad, hess, rows)
            sides.append((int(g), int(c), RATE * float(low), RATE * float(high)))
        trees.append(((int(f), int(cut)), *sides))
        margin = model.margin(x)
    for _ in range(50):  # Platt scaling on the held-out cells
        p = 1 / (1 + np.exp(-(model.a * margin + model.b)))
        w = cal_n * p * (1 - p)
        g = np.array([((cal_pos - cal_n * p) * margin).sum() - 1e-3 * (model.a - 1), (cal_pos - cal_n * p).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        model.a, model.b = model.a + float(np.clip(step[0], -1, 1)), model.b + float(np.clip(step[1], -1, 1))
    p = 1 / (1 + np.exp(-(model.a * margin + model.b)))
    order = np.argsort(-p)
    right = np.cumsum(cal_pos[order]) / np.maximum(np.cumsum(cal_n[order]), 1)
    ends = np.flatnonzero(np.append(np.diff(p[order]) < 0, True))
    good = [k for k in ends if right[k] >= PRECISION and cal_n[order][: k + 1].sum() >= LEAF_WEIGHT]
    if good:
        model.threshold = max(0.5, float(p[order][good[-1]]) - 1e-9)
    return model


def _filled(rnd: random.Random, pattern: str) -> str:
    """A pattern with each ``#`` a digit, ``~`` a hexadecimal digit, ``*`` a letter or digit, ``^`` an upper-case one, ``§`` a word."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    signs = {"#": "0123456789", "~": "0123456789abcdef", "*": "0123456789" + lower + lower.upper(), "^": "0123456789" + lower.upper()}
    word = lambda: "".join(rnd.choice(lower) for _ in range(rnd.randint(2, 8)))
    return "".join(rnd.choice(signs[c]) if c in signs else word() if c == "§" else c for c in pattern)


#: Shapes of data (kind, pattern) and of look-alikes in the notation of ``_filled``, and the words that stand before them.
SHAPES = [
    ("email", "§.##@§.§"), ("email", "§[at]§.§"), ("email", "§ (at) §.§"), ("email", "§ {at} § {dot} §"), ("email", "§ [at] § [dot] §"), ("email", "§ at § dot §"), ("ip", "1##.##.#.1##"), ("ip", "~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~"),
    ("card", "4### #### #### ####"), ("card", "5###############"), ("card", "################"), ("card", "################"), ("card", "4###.####.####.####"), ("card", "5###/####/####/####"), ("card", "3##############"),
    ("phone", "+1 (###) 555-####"), ("phone", "(###) ###-####"), ("phone", "###-###-####"), ("phone", "###.###.####"), ("phone", "### ### ####"), ("phone", "0##/### ####"), ("phone", "(0###) #### ####"), ("phone", "0####-######"),
]
LOOKALIKES = ["9##.8##.7##.#", "#############", "############", "###################", "000000000000000#", "1111 1111 1111 1111", "+# ## ##", "+####################", "0000-0000-0000-0000-#", "202#-0#-1# 1#:##:##", "#### #### #### #", "##################"]
NAMES = ["token", "secret", "password", "passwd", "api_key", "access_key", "credential"]
SECRETS = ["~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "~~~~~~~~~~~~~~~~~~~~~~~~", "************************", "************", "********1*"]
PLACEHOLDERS = ["§_§_§", "§-§-here", "§.§.§", "§§§", "########", "00000000", "your/§/§"]
KEYS = ["AKIA^^^^^^^^^^^^^^^^", "ghp_" + 36 * "*", "sk_live_" + 24 * "*"]
BEFORE = {"email": ["mail", "write to", "contact"], "ip": ["host", "server", "ip address"], "card": ["card", "visa", "pay with"], "phone": ["call", "phone:", "tel.", "mobile"]}
OTHERWISE = ["order", "serial", "hash", "version", "invoice no", "id", "isbn", "build", "part number"]


def labelled_findings(n: int = LABELLED_FINDINGS, seed: int = 23) -> list[tuple[int, str, int, int, str]]:
    """Generated findings (id, text, start, end, kind) with a known truth; look-alikes have kind ``none``.

    Data stand in prose, half of the time after a word that announces them.
    Look-alikes and, after words of other numbers, the shapes of data themselves
    are no personal data.
    """
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        prose = lambda: _filled(rnd, " ".join(rnd.choice(["§", "§", "§,"]) for _ in range(rnd.randint(3, 9))))
        draw = rnd.random()
        if draw < 0.5:
            kind, shape = rnd.choice(SHAPES)
            value = _filled(rnd, shape)
            before = rnd.choice(BEFORE[kind]) if rnd.random() < 0.5 else rnd.choice(["", "the", "and", "a"])
        elif draw < 0.68:
            kind, before = "secret", ""
            value = _filled(rnd, rnd.choice(KEYS)) if rnd.random() < 0.25 else rnd.choice(NAMES) + rnd.choice([' = "', "=", ": ", ' = ', '": "']) + _filled(rnd, rnd.choice(SECRETS))
        elif draw < 0.76:
            kind, before = "none", ""
            value = rnd.choice(NAMES) + rnd.choice([' = "', "=", ": "]) + _filled(rnd, rnd.choice(PLACEHOLDERS))
        elif draw < 0.88:
            kind, before, value = "none", rnd.choice(["", "the", *OTHERWISE]), _filled(rnd, rnd.choice(LOOKALIKES))
        else:
            kind, before, value = "none", rnd.choice(OTHERWISE), _filled(rnd, rnd.choice([s for kind, s in SHAPES if kind in ("card", "phone") and s[0] != "+"]))
        head = f"{prose()} {before} ".replace("  ", " ")
        text = head + value + rnd.choice([" ", ". ", ", ", '" ' if '"' in value else " "]) + prose()
        out.append((k, text, len(head), len(head) + len(value), kind))
    return out


def fit(spark: SparkSession, findings: list[tuple[int, str, int, int, str]] | None = None) -> Trees:
    """Train on labelled findings; only the counts of feature combinations reach the driver."""
    table = local_table(spark, findings or labelled_findings(), "doc_id long, text string, true_start long, true_end long, true_kind string").repartition(4, "doc_id")
    found = candidates(table).join(F.broadcast(table.drop("text")), "doc_id")
    label = ((F.col("kind") == F.col("true_kind")) & (F.col("start") < F.col("true_end")) & (F.col("end") > F.col("true_start"))).cast("int")
    names = [f"f_{x}" for x in FEATURES]
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    cells = found.withColumn("label", label).groupBy(*names).agg(
        F.sum(F.when(held, 0).otherwise(F.col("label"))).alias("pos"), F.sum(F.when(held, 0).otherwise(1)).alias("n"),
        F.sum(F.when(held, F.col("label")).otherwise(0)).alias("cal_pos"), F.sum(F.when(held, 1).otherwise(0)).alias("cal_n"),
    )
    rows = sorted(cells.collect())
    if not rows:
        return Trees([], 1.0, 0.0, 2.0)
    x = np.array([[r[c] for c in names] for r in rows], int)
    return boost(x, *(np.array([r[c] for r in rows], float) for c in ("pos", "n", "cal_pos", "cal_n")))


def select_spans(found: DataFrame, model: Trees) -> DataFrame:
    """The selected candidates: all accepted ones, and the best of each run of overlapping others over the threshold.

    Those others touch no accepted span, but for secrets, which may hold one.
    """
    rows = found.withColumn("p", model.probability()).where(F.col("accepted") | (F.col("p") >= model.threshold))
    doc = Window.partitionBy("doc_id", "text_key")
    before = doc.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = doc.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)  # a running minimum from the end, linear in the spans
    rows = rows.withColumn("base_end", F.max(F.when(F.col("accepted"), F.col("end"))).over(before)).withColumn("base_start", F.min(F.when(F.col("accepted"), F.col("start"))).over(after))
    free = (F.coalesce("base_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    rows = rows.where(F.col("accepted") | free | (F.col("kind") == "secret"))
    kindly = Window.partitionBy("doc_id", "text_key", "accepted")
    earlier = kindly.orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", (F.coalesce(F.max("end").over(earlier), F.lit(-1)) <= F.col("start")).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(kindly.orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("doc_id", "text_key", "accepted", "run").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "gen")
    rows = rows.withColumn("place", F.row_number().over(best)).where("accepted or place = 1")
    return rows.select("doc_id", "text_key", "kind", "start", "end", "accepted", "p")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the base counts, ``base`` (the base spans, listed), ``spans`` (all spans, listed), ``n_spans``."""
    found = written(candidates(docs, id_col, text_col), "candidates")
    picked = select_spans(found, fit(docs.sparkSession))
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("o"), "end", "kind")
    count = lambda k: F.count_if(F.col("accepted") & (F.col("kind") == k)).alias(f"n_{k}")
    by_doc = picked.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(*map(count, KINDS), F.sort_array(F.collect_list(F.when(F.col("accepted"), item))).alias("_base"), F.sort_array(F.collect_list(item)).alias("_all"))
    by_doc = by_doc.select("_id", "_key", *(f"n_{k}" for k in KINDS), _listed(F.col("_base")).alias("base"), _listed(F.col("_all")).alias("spans"), F.size("_all").alias("n_spans"))
    each = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"))
    by_doc = written(by_doc, "spans")
    out = each.join(maybe_broadcast(by_doc, limit=LISTS_ROWS), each["doc_id"].eqNullSafe(by_doc["_id"]) & (each["text_key"] == by_doc["_key"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in KINDS), "n_spans")]
    return out.select("doc_id", *counts[:-1], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"), counts[-1])


def _without(text: Column, cuts: Column) -> Column:
    """The text's parts ``from`` to ``start`` of each cut with its kind behind them.

    The text is taken apart into stretches first, so that a part is looked for in
    two stretches and not from the text's beginning.
    """
    def join(acc: Column, stretches: Column) -> Column:
        def one(c: Column) -> Column:
            a, b = F.floor(c["from"] / STRETCH).cast("int"), F.floor(c["start"] / STRETCH).cast("int")
            at = lambda k, first, n: F.coalesce(F.substring(F.get(stretches, k), first.cast("int"), n.cast("int")), F.lit(""))
            head, tail = c["from"] % STRETCH + 1, c["start"] % STRETCH
            far = F.concat(at(a, head, F.lit(STRETCH)), F.array_join(F.slice(stretches, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), at(b, F.lit(1), tail))
            return F.concat(F.when(a == b, at(a, head, c["start"] - c["from"])).otherwise(far), F.coalesce(F.concat(F.lit("["), c["kind"], F.lit("]")), F.lit("")))

        return F.concat(acc, F.array_join(F.transform(cuts, one), ""))

    # a fold over one element makes the stretches once and hands them to the inner function
    return F.aggregate(F.array(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0))), F.lit(""), join)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with every selected span replaced by its kind in brackets (overlapping spans by one)."""
    found = written(candidates(docs, id_col, text_col), "candidates")
    picked = select_spans(found, fit(docs.sparkSession))
    doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "kind")
    earlier = doc.rowsBetween(Window.unboundedPreceding, -1)
    rows = picked.withColumn("new", (F.coalesce(F.max("end").over(earlier), F.lit(-1)) <= F.col("start")).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    cut = runs.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("doc_id", "text_key").orderBy("start")), F.lit(0)))
    own_id, own_key, own_cuts = fresh(docs, "id"), fresh(docs, "key"), fresh(docs, "cuts")
    cuts = written(cut.groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.sort_array(F.collect_list(F.struct("from", "start", "end", "kind"))).alias(own_cuts)), "cuts")
    text = F.col(f"`{text_col}`")
    every = F.concat(own_cuts, F.array(F.struct(F.element_at(own_cuts, -1)["end"].alias("from"), F.length(text).cast("long").alias("start"), F.length(text).cast("long").alias("end"), F.lit(None).cast("string").alias("kind"))))
    clean = _without(text, every)
    joined = docs.join(maybe_broadcast(cuts), F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_key)), "left")
    return joined.select(*(F.when(F.col(own_cuts).isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
