"""Queries of the training-data operators over the given tables, and SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hearthwatch.llm import bpe, exact, language, mixing, near, pieces, quality, repeats, secrets, sharding, spelling, token_files, whitening
from hearthwatch.llm.base import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda s, d: quality.quality_verdicts(table(s, d, "documents"), table(s, d, "labels")),
    "op2_sharding": lambda s, d: sharding.sharded(table(s, d, "documents"), 16),
    # kept as the query's contract has it, by ids; the operator keeps one row of a component also where ids repeat
    "op3_minhash_near_dedup": lambda s, d: near.near_duplicates(table(s, d, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))),
    "op4_suffix_array_dedup": lambda s, d: repeats.without_repeats(table(s, d, "documents")),
    "op5_token_counts": lambda s, d: pieces.token_counts(table(s, d, "documents"), tokenizer_file("piece_bpe_32k.model")),
    "op6_secret_scans": lambda s, d: secrets.secret_spans(table(s, d, "documents")),
    "op7_exact_dedup": lambda s, d: exact.exact_duplicates(table(s, d, "documents")),
    "op8_language_id": lambda s, d: language.identified(language.documents_evidence(table(s, d, "documents")), "doc_id"),
    "op9_mixing_sources": lambda s, d: mixing.mixed_sources(table(s, d, "documents")),
    "op10_bpe_encoding": lambda s, d: bpe.encoded(table(s, d, "documents"), tokenizer_file("word_bpe_49k.json")),
    "op11_spelling_variants": lambda s, d: spelling.spelling_variants(table(s, d, "documents")),
    "op12_embedding_whitening": lambda s, d: whitening.whitened(table(s, d, "embeddings")),
    "op13_token_files": lambda s, d: token_files.stored_tokens(table(s, d, "documents"), tokenizer_file("byte_bpe_50k.json")),
    "pages_language_id": lambda s, d: language.identified(language.pages_evidence(table(s, d, "pages")), "page_id"),
    "pipeline": corpus_pipeline.run,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    # slots follow doc_id where the table is one part, as it is at the checked size
    "op2_sharding": """
WITH RECURSIVE bits AS (
  SELECT n AS id, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT id, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY id) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, t FROM documents, crc),
sums AS (
  SELECT doc_id, len(h) // 2 + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM docs
), jumps AS (
  SELECT doc_id, (coalesce(doc_id, -1)::HUGEINT & 18446744073709551615) AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) & 18446744073709551615 AS k2 FROM jumps WHERE j < 17)
), placed AS (
  SELECT doc_id, max(j) FILTER (j < 16)::INT AS shard, max(j) FILTER (j < 17)::INT AS grown_shard FROM jumps GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums JOIN placed USING (doc_id)""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS meet FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * meet >= 85 * (x.n + y.n - meet)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reached JOIN both_ways ON r = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op7_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents) WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_mixing_sources": f"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents
), drawn AS (
  SELECT doc_id, source, size, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest || ':'
    || (row_number() OVER (PARTITION BY source, doc_id, digest ORDER BY size) - 1)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM docs GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM sources WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN cap < found * w THEN cap ELSE found * w END::DOUBLE AS target
  FROM levels, (SELECT arg_min(level, cap::DOUBLE / w) AS found FROM levels WHERE cap >= level * w)
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM targets
), rests AS (
  SELECT *, CASE WHEN source_size > 0 AND target / source_size > copies THEN target - copies * source_size ELSE 0 END AS rest FROM whole
), tried AS (
  SELECT source, size, (rest - coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(squares) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rate
  FROM (SELECT d.source, size, rest, count(*) * size AS words, count(*)::HUGEINT * size * size AS squares
    FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source WHERE size > 0 GROUP BY d.source, size, rest)
  WINDOW o AS (PARTITION BY source ORDER BY size DESC)
), rates AS (SELECT source, arg_max(rate, size) AS rate FROM tried WHERE rate * size <= 1 GROUP BY source),
odds AS (
  SELECT d.doc_id, d.size, u, r.*, least(coalesce(rate * size, 0), 1) AS p
  FROM drawn d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN rates ON r.source IS NOT DISTINCT FROM rates.source
), ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM odds),
first AS (
  SELECT *, (p > 0 AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, u, size, doc_id ROWS UNBOUNDED PRECEDING) <= rest)::INT AS take FROM ranked
), opened AS (SELECT *, rest - coalesce(sum(size) FILTER (take = 1) OVER (PARTITION BY source), 0) AS open FROM first),
second AS (
  SELECT *, (take = 0 AND p > 0 AND size <= open) AS fits,
    sum(CASE WHEN take = 0 AND p > 0 AND size <= open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, u, size, doc_id ROWS UNBOUNDED PRECEDING) AS had FROM opened
), done AS (SELECT *, copies + CASE WHEN fits THEN (had <= open)::INT ELSE take END AS c FROM second)
SELECT doc_id, size, source_size, target, (c * size)::BIGINT AS taken, source, c::INT AS copies, p FROM done""",
    "op11_spelling_variants": """
WITH RECURSIVE bits AS (
  SELECT n AS id, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT id, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY id) AS t FROM bits WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM found WHERE length(r) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx, t,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(hx), 2), lambda i: ('0x' || substr(hx, i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM runs, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5
), cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT word, cut FROM cuts WHERE cut IN (SELECT word FROM words)
  UNION SELECT cut, word FROM cuts WHERE cut IN (SELECT word FROM words)
), near AS (
  SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -n, b := b)) AS best FROM pairs JOIN words ON b = words.word GROUP BY a
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 5 * n THEN best.b END AS form,
    CASE WHEN -best.less >= 5 * n THEN -best.less END::BIGINT AS form_n FROM words LEFT JOIN near USING (word)
), ways AS (
  SELECT word, word AS here, form AS ahead FROM forms UNION ALL SELECT ways.word, forms.word, form FROM ways JOIN forms ON ahead = forms.word
)
SELECT word, form, here AS root, n, n_near, form_n FROM forms JOIN ways USING (word) WHERE ahead IS NULL""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
