"""The dealt operators as queries over the synthetic tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbstat.llm import (
    alignment, chat, embeddings, lexical, licenses, packing, piece_fst, pii, ppm, quality, simhash, toxicity, url_rules,
)
from kerbstat.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the classifier adds."""
    return pii.digest(pii.find_personal_data(table(spark, folder, "documents")))


RULES = """
SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, verdict)
"""


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The rule that fits each page, and the verdict."""
    return url_rules.judge(table(spark, folder, "pages"), spark.sql(RULES))


def op3_pq_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93."""
    return embeddings.near_vectors(table(spark, folder, "embeddings"), least=0.93)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the only place that knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, cut and packed into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document; links at two or fewer bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SPOKEN_CONTROL = """
SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
  AS rows(conv_id, turn, role, text)
"""


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that speaks control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(rows.unionByName(spark.sql(SPOKEN_CONTROL))))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.digest(licenses.scan_licenses(table(spark, folder, "documents")))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every document."""
    judged = quality.apply_policies(quality.ledger(table(spark, folder, "documents")))
    base = F.col("failures").bitwiseAND(F.lit(quality.mask_of(quality.BASE))) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.col("kept_default_1").alias("kept"), "failures",
    )


def op9_ppm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Word baseline and byte model over all documents."""
    return ppm.score_documents(table(spark, folder, "documents"))


def op10_piece_transducer(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, their ids, and whether they decode to the document."""
    return piece_fst.encode_documents(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=True)


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, folder, "documents")
    return toxicity.digest(toxicity.score_documents(docs, toxicity.fit(docs, table(spark, folder, "labels"))))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how frequent the links are."""
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align_documents(table(spark, folder, "documents"), *paths)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_url_filters": op2_url_filters,
    "op3_pq_near_dedup": op3_pq_near_dedup,
    "op4_packing": op4_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_ppm_score": op9_ppm_score,
    "op10_piece_transducer": op10_piece_transducer,
    "op11_toxicity": op11_toxicity,
    "op12_token_alignment": op12_token_alignment,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
m AS (SELECT h.*, r.host || r.path AS rule, r.verdict,
        row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
      FROM h LEFT JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op3_pq_near_dedup": r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(a, b) AS (SELECT k, k FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT r.a AS k, min(w.vec_id) AS component_id FROM r JOIN v w ON w.k = r.b GROUP BY r.a),
n AS (SELECT a AS k, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN c USING (k) LEFT JOIN n USING (k)
""",
    "op6_chat_format": r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, regexp_replace(regexp_replace(role, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') AS er,
        regexp_replace(regexp_replace(text, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') AS et FROM t),
s AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
        sum(length(er) + length(et) + 20) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM s
""",
    "op7_license_scan": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS t FROM d),
b AS (SELECT k, i - 1 AS i, CASE WHEN ws[i : i + 1] = ['mit', 'license'] THEN 'mit'
    WHEN ws[i : i + 1] = ['apache', 'license'] THEN 'apache'
    WHEN ws[i : i + 2] = ['general', 'public', 'license'] THEN 'gpl' END AS label
  FROM d, unnest(range(1, len(ws) + 1)) AS r(i)),
n AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base
  FROM b WHERE label IS NOT NULL GROUP BY k),
m AS (SELECT k, list_filter([
""" + ",\n".join(
        f"    CASE WHEN regexp_matches(t, ' ({'|'.join(map(licenses.pattern, markups))})') THEN '{label}' END"
        for label, markups in licenses.TEMPLATES.items()
    ) + r"""], lambda x: x IS NOT NULL) AS found FROM s)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), found))), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d JOIN m USING (k) LEFT JOIN n USING (k)
""",
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, ws FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM p, unnest(range(1, len(ws) - 3)) AS r(i)),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM s, unnest(range(0, 5)) AS r(k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_lines AS BIGINT) AS n_lines,
        CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM p LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 2 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failures FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM b
""",
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ws FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ws)) AS BIGINT) AS nt FROM d WHERE len(ws) > 0),
u AS (SELECT k, unnest(ws) AS term FROM d),
t AS (SELECT k, term, count(*) AS tf FROM u GROUP BY k, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, nd),
p AS (SELECT t.k, t.term, f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * CAST(len(d.ws) AS BIGINT) * nd) // nt))) AS impact
      FROM t JOIN f USING (term) JOIN d USING (k), s),
r AS (SELECT q.i, q.item_id, p.k, CAST(sum(impact) AS BIGINT) AS score
      FROM (SELECT i, item_id, unnest(ws) AS term FROM q) q JOIN p USING (term) GROUP BY q.i, q.item_id, p.k),
o AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS n
      FROM r JOIN d USING (k) WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM o WHERE n <= 50
""",
}
