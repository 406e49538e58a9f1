"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from turnaround.llm import chat, mixing, neighbours, packing, phrases, pii, quality, simhash, spelling, spotsigs, substring, tokens, warc
from turnaround.llm.common import table
from turnaround.sources.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]

#: Conversation -7: its texts hold the template's control strings.
ODD_ID, ODD_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, 20)


def op2_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row per piece."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, perplexity and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as examples, these stored, and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(ODD_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"),
    )
    back = chat.read_back(materialize(chat.expand(turns.unionByName(odd)), "chat-examples"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and terms that give it away."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op7_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's weight, its probability and whether it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counted = docs.select(
        "doc_id", "source", "lang", mixing.form(F.col("text")).alias("topic"), mixing.word_count(F.col("text")).alias("n_tokens")
    )
    mixed = mixing.mix(materialize(counted, "token-counts"), mixing.EXPONENTS, mixing.SHARE)
    return mixed.select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept",
    )


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that repeat an earlier one, for every document."""
    return substring.duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives in ZIP packages and read back."""
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_rabin_karp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its form, the end of its chain of forms, and its near words."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [
        op1_cross_polytope, op2_length_packing, op3_simhash_trie, op4_perplexity_rules, op5_chat_examples,
        op6_disclosure, op7_raking, op8_unit_dedup, op9_token_counts, op10_warc_packages, op11_rabin_karp_phrases,
        op12_spotsigs, op13_spelling_variants,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


# --- SQL ------------------------------------------------------------------------------------------

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p AS (
  SELECT *, sum(8 + length(url_encode(role)) + length(regexp_replace(text, '(\\*</?turn)', '\\\1', 'g')) + 9)
              OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS so_far,
            lead(1) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NULL AS is_last
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(so_far) FILTER (role = 'assistant' OR is_last)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

WARC_SQL = """
WITH h AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages
), d AS (
  SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, (5 * g + 1)::INT, 5))::INT) AS parts FROM h
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((parts[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM d
"""


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
), phrases AS (
  SELECT lang, k.k AS width, unnest(list_transform(range(1, (len(w) - k.k + 2)::BIGINT), lambda i: w[i : i + k.k - 1])) AS w
  FROM lists, (VALUES (1), (2), (3)) k(k) WHERE len(w) >= k.k
), counted AS MATERIALIZED (
  SELECT lang, width, array_to_string(w, ' ') AS phrase, w, count(*) AS a FROM phrases GROUP BY ALL HAVING count(*) >= 10
), halves AS (
  SELECT lang, width, phrase, a, k.k, array_to_string(w[1 : k.k], ' ') AS head, array_to_string(w[k.k + 1 :], ' ') AS tail
  FROM counted JOIN (VALUES (1), (2)) k(k) ON k.k < width
), cuts AS (
  SELECT h.*, l.a AS l, r.a AS r, (1000000::HUGEINT * h.a * h.a) // (l.a::HUGEINT * r.a) AS score
  FROM halves h JOIN counted l ON l.lang = h.lang AND l.phrase = h.head JOIN counted r ON r.lang = h.lang AND r.phrase = h.tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), holders AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i.i : i.i + 1], ' ') AS phrase FROM counted, (VALUES (1), (2)) i(i) WHERE width = 3
  ) GROUP BY ALL
), free AS (
  SELECT b.* FROM best b LEFT JOIN holders h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE b.width = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * b.a
)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM free JOIN totals USING (lang)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""


def mixing_sql() -> str:
    exponents, share = mixing.EXPONENTS, mixing.SHARE
    margins = list(exponents)
    names = ", ".join(margins)
    goals = ",\n".join(
        f"g_{m} AS (SELECT {m}, pow(sum(tokens), {e}) / sum(pow(sum(tokens), {e})) OVER () AS t_{m} FROM cells GROUP BY {m})"
        for m, e in exponents.items()
    )
    steps, last = [], "s0"
    for i, m in enumerate(margins * mixing.ROUNDS, start=1):
        steps.append(
            f"s{i} AS (SELECT * REPLACE (w * t_{m} / sum(w) OVER (PARTITION BY {m}) AS w) FROM {last})"
        )
        last = f"s{i}"
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS marks
  FROM documents
), docs AS (
  SELECT doc_id, source, lang, n_tokens,
         CASE WHEN marks * 10 > n_tokens THEN 'marked' WHEN n_tokens < 100 THEN 'brief'
              WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic
  FROM counted
), cells AS (
  SELECT {names}, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0
), {goals},
s0 AS (
  SELECT *, tokens / sum(tokens) OVER () AS w FROM cells {" ".join(f"JOIN g_{m} USING ({m})" for m in margins)}
), {",".join(steps)},
fitted AS MATERIALIZED (SELECT {names}, tokens, w, w / tokens AS ratio FROM {last}),
total AS (SELECT sum(tokens) AS t, sum(w) AS w FROM fitted),
ordered AS (
  SELECT row_number() OVER o AS i, sum(tokens) OVER o AS tokens, sum(w) OVER o AS w, lead(ratio) OVER o AS following
  FROM fitted WINDOW o AS (ORDER BY ratio DESC, {names})
), scales AS (
  SELECT 0 AS i, {share} * t / w AS scale, (SELECT max(ratio) FROM fitted) AS following FROM total
  UNION ALL
  SELECT i, ({share} * t - o.tokens) / (total.w - o.w), following FROM ordered o, total WHERE following IS NOT NULL
), scale AS (SELECT arg_min(scale, i) AS scale FROM scales WHERE following IS NULL OR scale * following < 1),
p AS (SELECT {names}, w, least(1.0, ratio * scale) AS p FROM fitted, scale)
SELECT doc_id, {names}, n_tokens, round(CASE WHEN n_tokens > 0 THEN w ELSE 0.0 END, 9) AS weight,
       round(CASE WHEN n_tokens > 0 THEN p ELSE 0.0 END, 6) AS probability,
       coalesce(n_tokens > 0 AND ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 < p,
                false) AS kept
FROM docs LEFT JOIN p USING ({names})
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_examples": CHAT_SQL, "op7_raking": mixing_sql(), "op10_warc_packages": WARC_SQL,
        "op11_rabin_karp_phrases": PHRASES_SQL,
    }
