"""The operators over whole given tables, by query name, and their SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import bpe, exact_dedup, extraction, language, lm, packing, pii, quality, sharding, simhash, trie, variants, warc
from ledgerlark.llm.common import table

SHARDS = 24
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), SHARDS)


def op2_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extracted(table(spark, folder, "pages"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), WORD_BPE)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


OP5_SQL = """
WITH d AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
sums AS (SELECT *, from_hex(sha1(html)) AS raw, max(page_id) OVER (PARTITION BY html) AS largest FROM d),
bits AS (
    SELECT *, list_transform(range(1, 21), lambda i: lpad(bin(CAST('0x' || substring(hex(raw), CAST(2 * i - 1 AS INT), 2) AS INT)), 8, '0')) AS b
    FROM sums),
joined AS (SELECT *, array_to_string(b, '') AS w FROM bits)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substring(w, CAST(5 * i + k + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - k) AS INT)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM joined
"""


def op6_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.language_scores(table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t
    FROM documents),
w AS (
    SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d),
windows AS (SELECT rid, i, ws[i:i + 4] AS v FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, v) AS c FROM windows) WHERE c > 1),
covered AS (
    SELECT rid, sum(least(5, coalesce(following - i, 5))) AS n
    FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS following FROM again) GROUP BY rid),
lines AS (SELECT rid, host, t, unnest(ls) AS l, generate_subscripts(ls, 1) AS place FROM w),
plain AS (
    SELECT rid, host, t, place, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
           translate(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '123456789', '000000000') AS l
    FROM lines),
around AS (
    SELECT *, lag(l) OVER (PARTITION BY rid ORDER BY place) AS before,
           lead(l) OVER (PARTITION BY rid ORDER BY place) AS after
    FROM plain),
hosts AS (SELECT host, greatest(10, count(DISTINCT t) * 1 / 100) AS max_documents FROM d GROUP BY host),
often AS (
    SELECT host, l, count(DISTINCT t) AS documents,
           max(words) >= 3 AND 2 * count(DISTINCT before) >= count(DISTINCT t) AS opens,
           max(words) >= 3 AND 2 * count(DISTINCT after) >= count(DISTINCT t) AS closes
    FROM around JOIN hosts USING (host) GROUP BY host, l, max_documents HAVING count(DISTINCT t) > max_documents),
follows AS (
    SELECT host, l, before FROM around JOIN often USING (host, l) WHERE before IS NOT NULL
    GROUP BY host, l, before, documents HAVING 2 * count(DISTINCT t) > documents),
leads AS (
    SELECT host, l, after FROM around JOIN often USING (host, l) WHERE after IS NOT NULL
    GROUP BY host, l, after, documents HAVING 2 * count(DISTINCT t) > documents),
opened AS (
    SELECT host, l FROM often WHERE opens
    UNION
    SELECT follows.host, follows.l FROM opened JOIN follows ON follows.host = opened.host AND follows.before = opened.l),
closed AS (
    SELECT host, l FROM often WHERE closes
    UNION
    SELECT leads.host, leads.l FROM closed JOIN leads ON leads.host = closed.host AND leads.after = closed.l),
frequent AS (SELECT * FROM opened UNION SELECT * FROM closed),
removed AS (SELECT rid, sum(words) AS n FROM plain JOIN frequent USING (host, l) GROUP BY rid),
counted AS (
    SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed_words
    FROM w LEFT JOIN covered c USING (rid) LEFT JOIN removed r USING (rid)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_removed_words >= 10
           AND n_words - n_removed_words >= 0.3 * n_words AS kept, n_removed_words
FROM base
"""


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


OP9_SQL = r"""
WITH rows AS (
    SELECT doc_id, coalesce(length(text), 0) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
    FROM documents),
kept AS (
    SELECT *, count(*) OVER (PARTITION BY content) AS group_size,
           first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
    FROM rows WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM kept
"""

def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), BYTE_BPE)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes: one step for each bit."""
    bits = (
        f"flatten(list_transform(range(1, 2 * strlen({text}), 2),"
        f" lambda i: [CAST('0x' || substring(hex(encode({text})), CAST(i AS INT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    )
    step = "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), {step}), 4294967295)"


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
           unnest(regexp_extract_all(translate(text, '{variants.UPPER}', '{variants.LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
    FROM documents),
counted AS (SELECT doc || ':' || run AS named, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
summed AS (SELECT run, c, {crc32_sql("named")} AS h FROM counted),
changed AS (
    SELECT c, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word
    FROM summed),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (
    SELECT word, left(word, i) || '?' || substring(word, i + 2) AS masked, left(word, i) || substring(word, i + 2) AS shorter
    FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
near AS (
    SELECT a.word, b.word AS other FROM places a JOIN places b ON a.masked = b.masked AND a.word <> b.word
    UNION
    SELECT a.word, b.word FROM places a JOIN w b ON a.shorter = b.word
    UNION
    SELECT b.word, a.word FROM places a JOIN w b ON a.shorter = b.word),
ranked AS (
    SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
           row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place
    FROM near JOIN w ON w.word = other),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
           CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM w LEFT JOIN (SELECT * FROM ranked WHERE place = 1) USING (word)),
chains AS (
    SELECT word, word AS root, form AS onward FROM formed
    UNION ALL
    SELECT chains.word, f.word, f.form FROM chains JOIN formed f ON f.word = chains.onward)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chains WHERE onward IS NULL) USING (word)
"""


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


OP12_SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS donor, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (
    SELECT conv_id, 1 AS part, i, r, x FROM c JOIN t USING (conv_id) WHERE i >= h
    UNION ALL
    SELECT c.conv_id, 0, i, r, x FROM c JOIN t ON t.conv_id = c.donor WHERE i < h),
paths AS (
    SELECT conv_id, coalesce(p, []) AS p
    FROM c LEFT JOIN (
        SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY part, i) AS p FROM turns GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, len(p) AS n, d, p[1:d] AS q FROM paths, unnest(range(0, len(p) + 1)) AS u(d)),
nodes AS (
    SELECT q, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
           (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(q[d].x) END AS saved
    FROM prefixes GROUP BY q, d),
below AS (SELECT q[1:d - 1] AS q, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
subtree AS (
    SELECT q[1:e] AS q, e AS d, sum(saved) AS saved_tokens, count(*) FILTER (childless) AS n_leaves
    FROM (SELECT nodes.*, n_children IS NULL AS childless FROM nodes LEFT JOIN below USING (q, d)) AS s,
         unnest(range(0, s.d + 1)) AS u(e)
    GROUP BY ALL)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(nodes.ends) AS ends_sha256
FROM nodes
JOIN subtree USING (q, d)
LEFT JOIN below USING (q, d)
LEFT JOIN nodes AS up ON nodes.d > 0 AND up.d = nodes.d - 1 AND up.q = nodes.q[1:nodes.d - 1]
"""


def op13_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_extraction": op2_extraction,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_lm": op6_lm,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language": op13_language,
}

ORACLES: dict[str, str] = {
    "op5_warc": OP5_SQL,
    "op7_quality": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
