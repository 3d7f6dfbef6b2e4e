"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, html_text, langid, near_duplicates, packing, quotations, repair, scoring, sharding, substrings, token_counts, topk
from .common import table


def op1_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), both_ends=True).select("doc_id", "text", "removed_sentences")


def op2_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(table(spark, sf_dir, "conversations"))


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_audit(table(spark, sf_dir, "conversations"))


def op12_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentence_span_dedup, op2_ecoc_language_id, op3_min_slack_packing, op4_bm25_decontamination, op5_trie_token_counts, op6_text_density, op7_quotation_linking, op8_pivot_topk, op9_weighted_minhash, op10_hash_tree_sharding, op11_structure_repair, op12_phrase_tries, op13_backoff_automaton)}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, by bits."""
    eight = "list_reduce([xor(crc, byte)] || list_transform(range(8), lambda i: CAST(i AS BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte: {eight}), 4294967295)"


def _repair_step() -> tuple[str, str, str]:
    """The options of each state (nothing, system, user, assistant) before a row, and the same with an insert before it."""
    fits, role = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    kept = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    turn = lambda n, cost, edit, name, text: f"{{'c': n{n}.c + {cost}, 'a': '{edit}' || n{n}.a, 'r': list_prepend({name} || ':' || {text}, n{n}.r)}}"
    options = []
    for x in range(4):
        keep = "CASE " + " ".join(f"WHEN ok AND left(role, 1) = '{i}' THEN {turn(to, 'more', 'K', 'role', 'text')}" for i, to in kept[x].items()) + " END"
        rerole = f"CASE WHEN ok THEN {turn(fits[x], '3 + more', 'R', quoted(role[fits[x]]), 'text')} END"
        options.append(f"list_sort(list_filter([{{'c': n{x}.c + 4, 'a': 'D' || n{x}.a, 'r': n{x}.r}}, {keep}, {rerole}], lambda o: o IS NOT NULL))[1] AS b{x}")
    put = lambda to: f"{{'c': {to}.c + 3, 'a': 'I' || {to}.a, 'r': list_prepend('{'user' if to[1] == '2' else 'assistant'}:', {to}.r)}}"
    least = lambda a, b: f"list_sort([{a}, {put(b)}])[1]"
    return ", ".join(options), f"{least('b0', 'v2')} AS n0, {least('b1', 'v2')} AS n1, v2 AS n2, {least('b3', 'b2')} AS n3", f"{least('b2', 'b3')} AS v2"


def quoted(x: str) -> str:
    return f"'{x}'"


_OPTIONS, _CLOSED, _USER = _repair_step()
REPAIR_SQL = f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM m WHERE hit <> 0
), o AS (
  SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS total,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS t,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM d
), f AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY t) || left(role, 1) AS pair
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                       WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o)
), g AS (
  SELECT conv_id, total AS t, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS n0, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS n1,
         {{'c': 3, 'a': 'I', 'r': ['assistant:']}} AS n2, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS n3
  FROM (SELECT DISTINCT conv_id, total FROM f)
  UNION ALL
  SELECT conv_id, t - 1 AS t, {_CLOSED}
  FROM (SELECT *, {_USER} FROM (SELECT g.conv_id AS conv_id, g.t AS t, {_OPTIONS} FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.t = f.t))
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), r AS (
  SELECT c.*, g.n0.c AS cost, g.n0.a AS audit, sha256(array_to_string(g.n0.r, chr(10))) AS repaired_sha256
  FROM c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id AND g.t = 0
)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN r ON k.conv_id IS NOT DISTINCT FROM r.conv_id
"""


COLLOCATION_SQL = r"""
WITH p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS words
  FROM p, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k
), f AS (SELECT lang, k, words, count(*) AS f FROM g GROUP BY lang, k, words HAVING count(*) >= 10
), c AS (SELECT lang, k, words, f AS a FROM f WHERE k > 1
), cuts AS (SELECT lang, words, a, unnest(range(1, k)) AS cut FROM c
), s AS (
  SELECT u.lang, u.words, a, cut, x.f AS l, y.f AS r, (1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.words = u.words[1 : cut] JOIN f y ON y.lang = u.lang AND y.words = u.words[cut + 1 :]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([words[1:2], words[2:3]]) AS part FROM c WHERE k = 3) GROUP BY lang, part
), ranked AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score
  FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.part = b.words
  WHERE len(b.words) = 3 OR most IS NULL OR 100 * most < 50 * a
), top AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked
), total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang)
SELECT top.lang AS lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM top JOIN total ON total.lang = top.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_pivot_topk": TOPK_SQL, "op11_structure_repair": REPAIR_SQL, "op12_phrase_tries": COLLOCATION_SQL}
