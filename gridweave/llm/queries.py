"""The queries ``opN_<name>`` and their SQL; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridweave.llm.ann import nearest
from gridweave.llm.bpe import encode_digests
from gridweave.llm.common import table
from gridweave.llm.conversations import conversation_report
from gridweave.llm.filter_audit import filter_audit
from gridweave.llm.licenses import license_notices
from gridweave.llm.lm import score_documents
from gridweave.llm.near_vectors import near_vectors
from gridweave.llm.ngram_join import ngram_join
from gridweave.llm.packing import pack
from gridweave.llm.paragraphs import paragraph_duplicates
from gridweave.llm.pii import personal_data_digests
from gridweave.llm.quality import quality_report
from gridweave.llm.secrets import secret_digests


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(table(spark, sf_dir, "documents"))


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


REGISTERED = (
    op1_pii_weak_supervision,
    op2_recurrent_lm,
    op3_one_bit_codes,
    op4_bpe_automaton,
    op5_paragraph_minhash,
    op6_secret_grammars,
    op7_quality_rules,
    op8_license_dice,
    op9_best_fit_packing,
    op10_ngram_jaccard,
    op11_epsilon_grid,
    op12_filter_audit,
    op13_conversation_repair,
)


WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
TEXT = "coalesce(text, '')"
FOLDED = f"translate({TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, {TEXT} AS t, {WORDS.format(text=TEXT)} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM r) GROUP BY doc_id),
f AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, len(l) AS lines, coalesce(f.n, 0) AS top
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > word_chars OR 100 * n_dup_lines > 70 * lines OR 2 * digits > word_chars
    OR word_chars > 40 * n_words OR 3 * word_chars < 4 * n_words OR 2 * top > n_words) AS kept
FROM b"""

JOIN_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.other)
SELECT c.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM c LEFT JOIN n USING (doc_id) GROUP BY c.doc_id"""


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a AS r, count(*) AS n FROM p GROUP BY a),
c AS (SELECT r, r AS other FROM v UNION SELECT c.r, p.b FROM c JOIN p ON p.a = c.other),
m AS (SELECT c.r, min(o.vec_id) AS component_id FROM c JOIN v o ON o.r = c.other GROUP BY c.r)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)"""

AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, {TEXT} AS t, {WORDS.format(text=TEXT)} AS w FROM documents),
m AS (
  SELECT doc_id, part, (len(w) < 50)::INTEGER + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INTEGER AS m FROM d),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
h AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)),
r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (m & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (m & before <> 0 AND m & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


#: Damage by crc32, faults, and the cheapest (cost, audit, lines) of each state after each row, with up to two inserted turns behind it.
REPAIR_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: xor(crc >> 8, list_reduce([xor(crc, b) & 255] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295) % 20 AS kind
  FROM conversations),
hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM hit),
r AS (
  SELECT *, left(role, 1) AS f, CASE WHEN mark = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM num),
c AS (SELECT DISTINCT conv_id FROM conversations),
s AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || f NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
  FROM c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, unnest(['', 'u', 'a']) AS state,
    unnest([{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}, {'cost': 2, 'audit': 'I', 'lines': ['user:']}, {'cost': 4, 'audit': 'II', 'lines': ['user:', 'assistant:']}]) AS best FROM c
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT conv_id, i, CASE k WHEN 0 THEN x.st WHEN 1 THEN x.nx ELSE CASE x.nx WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
      {'cost': best.cost + x.cost + 2 * k, 'audit': best.audit || x.letter || repeat('I', k),
       'lines': list_concat(best.lines, x.lines, CASE k WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [x.name] ELSE [x.name, CASE x.nx WHEN 'u' THEN 'assistant:' ELSE 'user:' END] END)} AS best
    FROM (
      SELECT *, unnest(range(3))::INTEGER AS k FROM (
        SELECT conv_id, i, best, {'cost': e.cost, 'letter': e.letter, 'st': e.st, 'lines': e.lines, 'nx': CASE e.st WHEN 'u' THEN 'a' ELSE 'u' END,
          'name': CASE e.st WHEN 'u' THEN 'assistant:' ELSE 'user:' END} AS x FROM (
          SELECT conv_id, i, best, unnest(list_filter([
            {'cost': 3, 'letter': 'D', 'st': state, 'lines': []::VARCHAR[], 'may': true},
            {'cost': cut, 'letter': 'K', 'st': f, 'lines': [role || ':' || text], 'may': fault NOT IN ('b', 'd') AND (f = nx OR (f = 's' AND state = ''))},
            {'cost': 2 + cut, 'letter': 'R', 'st': nx, 'lines': [CASE nx WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text], 'may': fault NOT IN ('b', 'd')}], lambda z: z.may)) AS e
          FROM (
            SELECT w.conv_id, r.i, w.state, w.best, r.role, r.text, r.f, r.fault, (r.fault = 't')::INTEGER AS cut, CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END AS nx
            FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)))))
  GROUP BY conv_id, i, state)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, min(best).cost::BIGINT AS cost, min(best).audit AS audit, sha256(array_to_string(min(best).lines, chr(10))) AS repaired_sha256
FROM s JOIN walk w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n AND w.state IN ('', 'a')
GROUP BY s.conv_id, gaps, blank, duplicate, truncated, illegal"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op7_quality_rules": QUALITY_SQL, "op10_ngram_jaccard": JOIN_SQL, "op11_epsilon_grid": VECTORS_SQL, "op12_filter_audit": AUDIT_SQL, "op13_conversation_repair": REPAIR_SQL}
