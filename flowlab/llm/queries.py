"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.bpe import read_ranks, round_trip
from flowlab.llm.chat import chat_windows, digest_conversations
from flowlab.llm.decontaminate import mark_contaminated
from flowlab.llm.html_text import extract_text
from flowlab.llm.importance import resample
from flowlab.llm.lines import BOILERPLATE, NAVIGATION, PUNCTUATED, clean_lines
from flowlab.llm import lm_score
from flowlab.llm.lm_score import score_texts
from flowlab.llm.merkle import fold, merkle_paths, proof_digest, record_digest
from flowlab.llm.near_dup import link_documents
from flowlab.llm.passages import shared_passages
from flowlab.llm.secrets import digest_secrets
from flowlab.llm.toxicity import fit, held_out, sample_labelled, score_toxicity
from flowlab.llm.url_rules import BAD_HOST_WORDS, PATTERNS, HostRule, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"


@query("op1_decontaminate", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)),
m AS (SELECT r, i, place.n, item_id FROM place JOIN win USING (s) WHERE place.n = win.n),
hit AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_hit FROM (SELECT r, i, unnest(range(n)) AS k FROM m) GROUP BY r),
it AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_ESCAPED = "replace(replace(replace(replace({}, '\\', '\\e'), '<', '\\l'), '[', '\\b'), ']', '\\c')"


@query("op5_chat_windows", rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, len(regexp_extract_all(text, '{_SPACED}')) + 1 AS tokens,
        11 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS number FROM raw),
s AS (SELECT *, number = 1 AND role = 'system' AS is_system,
        coalesce(max(CASE WHEN number = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS own,
        max(CASE WHEN number = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS own_chars,
        sum(tokens) OVER (PARTITION BY conv_id ORDER BY number) AS total FROM n),
p AS (SELECT *, CASE WHEN is_system THEN 0 ELSE total - own - tokens END AS start, CASE WHEN is_system THEN 0 ELSE total - own END AS stop FROM s),
w AS (SELECT *, start // greatest(1, 192 - own) AS win FROM p),
e AS (SELECT *, max(stop) OVER (PARTITION BY conv_id, win) AS span_stop, max(win) OVER (PARTITION BY conv_id) AS last_win FROM w),
f AS (SELECT conv_id, sum(chars) + sum(CASE WHEN span_stop - start <= 64 AND win < last_win AND NOT is_system THEN chars ELSE 0 END)
             + coalesce(max(own_chars), 0) * (count(DISTINCT win) - 1) AS formatted_chars FROM e GROUP BY conv_id),
t AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY number) AS said,
        coalesce(string_agg(text, '' ORDER BY number) FILTER (WHERE role = 'assistant'), '') AS learnt FROM n GROUP BY conv_id)
SELECT t.conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                    "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return digest_conversations(chat_windows(turns))


def _line_rules_sql() -> str:
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    return f"NOT ({phrases} OR regexp_matches(l, '{NAVIGATION}') OR s > 0.5 * n OR (n >= 30 AND NOT regexp_matches(l, '{PUNCTUATED.replace(chr(39), chr(39) * 2)}')))"


@query("op6_clean_lines", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM (SELECT r, i, unnest(range(5)) AS k FROM
        (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c >= 2) GROUP BY r),
l AS (SELECT r, l, len(regexp_extract_all(l, '{_SPACED}')) AS n, length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS s
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)),
k AS (SELECT r, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN {_line_rules_sql()} THEN 0 ELSE n END) AS lost FROM l WHERE n > 0 GROUP BY r),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN rep USING (r) LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5 * n_words AS kept
FROM a
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules of the contract.
URL_RULES = [HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"),
             HostRule("net", "/es/", "block"), HostRule("net", "/fr/", "block")]
_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)


@query("op9_url_rules", rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v(rh, rp, verdict) AS (VALUES {_RULE_ROWS}),
b AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM p, v WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[^0-9a-z])({"|".join(BAD_HOST_WORDS)})([^0-9a-z]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (r)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES + PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_secrets(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(sample_labelled(docs, table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op10_context_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), lm_score.held_out("doc_id"))


@query("op8_shared_passages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


@query("op11_html_text", r"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url,
             regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '\s+', ' ', 'g') AS x FROM pages),
b AS (SELECT r, page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT r, page_id, url, replace(replace(regexp_replace(x, '&amp;?', chr(1), 'g'), '&quot;', '"'), chr(1), '&') AS x FROM b),
l AS (SELECT r, page_id, url, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, ' +', ' ', 'g'))), lambda y: y <> '') AS lines FROM c)
SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text, length(coalesce(array_to_string(lines, chr(10)), ''))::BIGINT AS n_chars FROM l
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: CRC-32 of a text in SQL: its table, and the loop over the text's bytes (hex digits of UTF-8).
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS entry
    FROM (SELECT unnest(range(256)) AS n))"""


def _crc32_sql(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295)"


#: The fields of a leaf, in order.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(fields: list[str]) -> str:
    texts = [f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(texts)})"


@query("op12_merkle", f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('+' || lang, '') AS g, {_leaf_sql(LEAF_FIELDS)} AS leaf,
        CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql(["n_chars + 1" if f == "n_chars" else f for f in LEAF_FIELDS])} END AS tampered
      FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
node(level, g, i, m, h) AS (
  SELECT 0, g, i, m, leaf FROM l
  UNION ALL
  SELECT level + 1, g, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE m > 1 GROUP BY level, g, i // 2, m),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM node WHERE m = 1),
top(level, i, m, h) AS (
  SELECT 0, i, m, h FROM sub
  UNION ALL
  SELECT level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE m > 1 GROUP BY level, i // 2, m),
tall AS (SELECT g, max(level) AS height FROM node GROUP BY g),
climb(r, g, level, i, m, h, proof) AS (
  SELECT r, g, 0, i, m, coalesce(tampered, leaf), '' FROM l
  UNION ALL
  SELECT c.r, c.g, c.level + 1, c.i // 2, (c.m + 1) // 2, sha256(CASE WHEN c.i % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN node s ON s.level = c.level AND s.g = c.g AND s.i = xor(c.i, 1) WHERE c.m > 1),
climb_top(r, level, i, m, h, proof) AS (
  SELECT c.r, 0, sub.i, sub.m, c.h, c.proof FROM climb c JOIN sub ON sub.g = c.g WHERE c.m = 1
  UNION ALL
  SELECT c.r, c.level + 1, c.i // 2, (c.m + 1) // 2, sha256(CASE WHEN c.i % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, '')
  FROM climb_top c LEFT JOIN top s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.m > 1)
SELECT l.doc_id, l.leaf, sub.h AS subroot, t.h AS root, sha256(p.proof) AS proof_sha256, p.h AS folded_root, p.h = t.h AS verified
FROM l JOIN sub ON sub.g = l.g JOIN climb_top p ON p.r = l.r AND p.m = 1, (SELECT h FROM top WHERE m = 1) t
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {f: F.col(f) for f in LEAF_FIELDS}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(changed, record_digest(*(fields | {"n_chars": F.col("n_chars") + 1}).values()))
    leaves = docs.select("doc_id", "lang", record_digest(*fields.values()).alias("original"), tampered.alias("tampered"))
    paths = merkle_paths(leaves, F.col("original"), "lang", "doc_id")
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return (paths.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@query("op13_importance", rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
fd AS (SELECT r, unnest(w) AS word FROM d),
fb AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
vocab AS (SELECT word, {_crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM fd UNION SELECT word FROM fb), crc_table),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN vocab USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN vocab USING (word) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM fd) AS s_all, (SELECT count(*) FROM fb) AS t_all),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
w AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fd JOIN vocab USING (word) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
g AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM g WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM g LEFT JOIN k USING (r)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
