"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import (
    bpe,
    chat,
    compression,
    decontamination,
    lines,
    merkle,
    near_dups,
    repetition,
    secrets,
    substrings,
    token_files,
    toxicity,
    trie,
)
from tidemart.llm.common import ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: A conversation whose texts look like the template of several chat formats.
TRAP = "\\### Assistant: </turn> ok"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.read_token_files(token_files.write_token_files(docs, VOCABULARY, END_ID))


@query
def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, named by its least id."""
    return near_dups.near_classes(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "class_id")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.scan_secrets(
        table(spark, sf_dir, "documents", "doc_id", "text")))


@query
def op4_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item whose passage it holds, within the error budget."""
    found = decontamination.match_benchmark(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", F.inline("found")).select("doc_id", "item_id", "distance")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(
        F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.drop("n_repeats", "longest_repeat", "spans")


@query
def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    decoded = bpe.round_trip(docs, VOCABULARY)
    return decoded.select("doc_id", "n_tokens", "ids_sha256",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return toxicity.score(docs, chain).drop("text")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP).alias("text"))
    return chat.chat_digest(chat.format_chats(turns.unionByName(trap)))


@query
def op11_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = compression.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out))
    return compression.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(merkle.leaves(docs, {"n_chars": F.col("n_chars") + 1}, tampered))
    folded = F.element_at("copied", -1)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
                        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return trie.prefix_trie(trie.rebuilt(trie.conversations(turns))).drop("turn_id")


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in SQL, bit by bit."""
    step = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), " \
           "lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, byte: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# Trees of both kinds, level by level: g names the tree, i the node in its level. Every node's parent
# and sibling, then every leaf's siblings bottom up and the path folded from its changed leaf.
ORACLE["op12_merkle_manifest"] = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
levels AS (
  SELECT 0 AS level, lang, i, leaf AS h, n FROM t
  UNION ALL
  SELECT level + 1, lang, i // 2,
    sha256(h || coalesce(lead(h) OVER (PARTITION BY lang ORDER BY i), '')), (n + 1) // 2
  FROM (SELECT *, row_number() OVER () FROM levels WHERE n > 1) QUALIFY i % 2 = 0),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(h || coalesce(lead(h) OVER (ORDER BY i), '')), (n + 1) // 2
  FROM (SELECT *, row_number() OVER () FROM tops WHERE n > 1) QUALIFY i % 2 = 0),
climb AS (
  SELECT doc_id, leaf, lang, 0 AS level, i, n, other AS h, '' AS proof FROM t
  UNION ALL
  SELECT doc_id, leaf, c.lang, c.level + 1, c.i // 2, (c.n + 1) // 2,
    CASE WHEN c.i % 2 = 1 THEN sha256(s.h || c.h) ELSE sha256(c.h || coalesce(s.h, '')) END,
    proof || coalesce(s.h, '')
  FROM climb c LEFT JOIN levels s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.i = xor(c.i, 1)
  WHERE c.n > 1),
upper AS (
  SELECT doc_id, leaf, c.lang, 0 AS level, s.i, s.n, c.h, proof
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT doc_id, leaf, u.lang, u.level + 1, u.i // 2, (u.n + 1) // 2,
    CASE WHEN u.i % 2 = 1 THEN sha256(s.h || u.h) ELSE sha256(u.h || coalesce(s.h, '')) END,
    proof || coalesce(s.h, '')
  FROM upper u LEFT JOIN tops s ON s.level = u.level AND s.i = xor(u.i, 1) WHERE u.n > 1)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root,
  u.h = r.h AS verified
FROM upper u JOIN subroots s ON s.lang IS NOT DISTINCT FROM u.lang, (SELECT h FROM tops WHERE n = 1) r
WHERE u.n = 1
"""


ORACLE["op13_conversation_trie"] = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
  {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
    sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
m AS (SELECT *, lag(path) OVER w AS parent, lead(path) OVER w IS NULL AS ends FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs,
    (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY path, depth),
kids AS (SELECT parent AS path, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT p.path, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE kids.path IS NULL) AS n_leaves
  FROM n LEFT JOIN kids USING (path) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path)
SELECT n.depth, n.conv_id, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n AS up ON up.path = n.parent LEFT JOIN kids ON kids.path = n.path
  JOIN below ON below.path = n.path
"""


def _escaped(column: str) -> str:
    return rf"replace(replace({column}, '\', '\b'), '<', '\l')"


ORACLE["op10_chat_format"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
r AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i)) AS loss_sha256,
  CAST(sum(CASE WHEN before = role THEN 6 ELSE
             CASE WHEN i > 1 THEN 8 ELSE 0 END + 7
             + length(replace({_escaped('role')}, chr(10), '\n')) END
           + length({_escaped('text')})) + 8 AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


ORACLE["op9_substring_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, g.i, md5(array_to_string(words[g.i:g.i + 49], ' ')) AS k
  FROM t, unnest(range(1, len(words) - 48)) AS g(i)),
gone AS (
  SELECT DISTINCT doc_id, i + j.n AS i
  FROM w JOIN (SELECT k, min(doc_id) AS least FROM w GROUP BY k) USING (k), range(50) AS j(n)
  WHERE doc_id > least),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, g.i, words[g.i] AS word FROM t, unnest(range(1, len(words) + 1)) AS g(i))
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


def _repeated(name: str, size: int) -> str:
    """Words in windows of ``size`` that occur twice or more in their text."""
    return f"""
{name}_all AS (
  SELECT doc_id, g.i, md5(array_to_string(words[g.i:g.i + {size - 1}], ' ')) AS k
  FROM t, unnest(range(1, len(words) - {size - 2})) AS g(i)),
{name} AS (
  SELECT doc_id, count(DISTINCT i + j.n) AS n
  FROM {name}_all JOIN (SELECT doc_id, k FROM {name}_all GROUP BY ALL HAVING count(*) > 1) USING (doc_id, k),
    range({size}) AS j(n)
  GROUP BY doc_id)"""


_RULES = repetition.Limits()
ORACLE["op6_repetition_rules"] = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
{_repeated("short", 3)},
{_repeated("long", _RULES.least_repeat)},
{_repeated("longest", _RULES.longest_repeat + 1)},
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(short.n, 0) AS n_repeat_words,
    coalesce(long.n, 0) AS covered_words, coalesce(longest.n, 0) AS too_long
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN short USING (doc_id) LEFT JOIN long USING (doc_id)
    LEFT JOIN longest USING (doc_id))
SELECT * EXCLUDE (too_long), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND too_long = 0
    AND covered_words <= {_RULES.most_covered} * n_words AS kept
FROM counted
"""
