"""The registered queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import centroid_clusters, chat_format, compression_classifier, language_id, phrase_mining
from marlstone.llm.common import held_out, local_table, read_table
from marlstone.llm.decontamination import scan_documents
from marlstone.llm.ngram_join import ngram_jaccard_join
from marlstone.llm.packing import pack, token_pieces
from marlstone.llm.pii import find_pii
from marlstone.llm.quality_rules import BIT, ledger, verdict
from marlstone.llm.resharding import reshard
from marlstone.llm.secret_scan import scan_secrets
from marlstone.llm.url_filter import judge_urls

#: op1: the documents lie in so many shards, dealt by the checksum of their id, and go to so many.
OLD_SHARDS, NEW_SHARDS = 6, 8
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    old = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % OLD_SHARDS
    placed = reshard(docs, old, NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(read_table(spark, sf_dir, "documents")))


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def linked_pages_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third operator where there are aliases: every page names the first of its three as canonical."""
    pages = read_table(spark, sf_dir, "pages")
    first = pages.select(F.col("page_id").alias("first"), F.col("url").alias("target"))
    link = F.concat(F.lit('<link rel="canonical" href="'), F.col("target"), F.lit('">'))
    linked = pages.join(first, F.col("page_id") - F.col("page_id") % 3 == F.col("first"), "left").select("page_id", "url", link.alias("html"))
    return judge_urls(linked, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_bayes_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))), F.col("lang"))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = compression_classifier.train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = compression_classifier.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(("base", 1))).alias("base_failed"), verdict().alias("kept"), "failure_bits",
    )


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_spans")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_jaccard_join(read_table(spark, sf_dir, "documents"), n=4, threshold=Fraction(85, 100))
    return members.select("doc_id", "n_shingles", "component_id")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), n=10)
    names = F.concat_ws(",", "items")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"), path_col="source")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(read_table(spark, sf_dir, "documents"))


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = centroid_clusters.cluster(read_table(spark, sf_dir, "embeddings"))
    return found


def op13_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as the log of a chat server (:func:`chat_format.log_of_rows`), folded, rendered and read back."""
    more = local_table(spark, [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(["user", "assistant"])], "conv_id bigint, turn bigint, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_conversations(chat_format.log_of_rows(rows)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flow_resharding": op1_flow_resharding,
    "op2_swap_packing": op2_swap_packing,
    "op3_redirect_equivalence": op3_redirect_equivalence,
    "linked_pages_redirect_equivalence": linked_pages_redirect_equivalence,
    "op4_bayes_language_id": op4_bayes_language_id,
    "op5_compression_classifier": op5_compression_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_boosted_pii": op7_boosted_pii,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_forest": op10_secret_forest,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_annulus_clusters": op12_annulus_clusters,
    "op13_event_sourced_chat": op13_event_sourced_chat,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
u AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p WHERE c IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, ((n_words < 50)::BIGINT * {BIT['too_few_words']} + (100 * n_repeat_words > 50 * n_words)::BIGINT * {BIT['repeated_windows']}
      + (10 * n_symbols > 3 * n_words)::BIGINT * {BIT['symbol_heavy']} + (2 * n_dup_lines > n_lines)::BIGINT * {BIT['duplicate_lines']}
      + (word_chars < 2 * n_words)::BIGINT * {BIT['short_words']} + (word_chars > 20 * n_words)::BIGINT * {BIT['long_words']}) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
""",
    "op3_redirect_equivalence": r"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
p AS (SELECT page_id, url, html, split_part(url, '#', 1) AS node FROM pages),
tags AS (SELECT url, node, unnest(list_concat(
    list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b')),
    list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')))) AS tag FROM p WHERE url IS NOT NULL),
raw AS (SELECT url, node, trim(replace(regexp_extract(tag, '(?i)(?:\bhref\s*=\s*|\burl\s*=\s*)["'']?([^"''\s>]+)', 1), '&amp;', '&')) AS t,
    regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS site, split_part(url, '://', 1) AS scheme, regexp_extract(url, '^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM tags),
edges AS (SELECT node AS src, split_part(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN site || t
    WHEN ends_with(folder, '/') THEN folder || t ELSE folder || '/' || t END, '#', 1) AS dst FROM raw WHERE t <> ''),
places AS (SELECT DISTINCT u FROM (SELECT url AS u FROM p UNION ALL SELECT node FROM p UNION ALL SELECT src FROM edges UNION ALL SELECT dst FROM edges)),
rest AS (SELECT u, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM places),
parts AS (SELECT u, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT u, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM (SELECT parts.*, rules.* FROM parts LEFT JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) GROUP BY ALL),
sides AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(u) AS (SELECT a FROM sides JOIN best ON best.u = a WHERE verdict = 'block' UNION SELECT b FROM reach JOIN sides ON a = reach.u)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, CASE WHEN node IN (SELECT u FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON best.u = p.url
""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN link ON r = x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY ALL
""",
    "op9_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item, w, least(len(w), 10) AS k FROM q WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
sizes AS (SELECT DISTINCT k FROM k),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, dw.k, i, item FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
""",
}

SQL["linked_pages_redirect_equivalence"] = SQL["op3_redirect_equivalence"].replace(
    "p AS (SELECT page_id, url, html, split_part(url, '#', 1) AS node FROM pages)",
    """linked AS (SELECT a.page_id, a.url, '<link rel="canonical" href="' || b.url || '">' AS html FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id - a.page_id % 3),
p AS (SELECT page_id, url, html, split_part(url, '#', 1) AS node FROM linked)""",
)

SQL["op11_phrase_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, w[i : i + k - 1] AS ph, k, count(*) AS f FROM starts, range(1, 6) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, unnest([ph[1 : k - 1], ph[2 : k]]) AS ph, f AS b FROM f WHERE k > 2),
c AS (SELECT lang, ph, k, f AS a FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = f.lang AND inside.ph = f.ph AND 100 * b >= 100 * f.f)),
cuts AS (SELECT lang, ph, a, j, ph[1 : j] AS x, ph[j + 1 : k] AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.ph, a, j, fx.f AS l, fy.f AS r, n, ((1000::HUGEINT * a * n) // (fx.f::HUGEINT * fy.f))::BIGINT AS score
           FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.ph = x JOIN f fy ON fy.lang = cuts.lang AND fy.ph = y JOIN totals ON totals.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
ranked AS (SELECT *, array_to_string(ph, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The fixed rounds one after another."""
    steps = [rf"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT r, vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := k)) AS m FROM kept, c{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT m.k AS k, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{i}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY k)""")
            steps.append(f"""c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = m.k
"""


SQL["op12_annulus_clusters"] = _clusters_sql()

SQL["op13_event_sourced_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*(?:\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|\|endoftext\|>))', '\1\\\2', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*(?:\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]|\|endoftext\|>))', '\1\\\2', 'g')) + 8 + 8 + 8 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
