"""The corpus queries: thin, each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.bpe import bpe_round_trip
from factlake.llm.codes import codebooks_digest, vector_codes
from factlake.llm.common import fresh_path, table
from factlake.llm.decontaminate import contaminated
from factlake.llm.fim import fill_in_middle, restored
from factlake.llm.fingerprints import edited_fingerprints
from factlake.llm.lines import line_dedup
from factlake.llm.near import near_duplicates
from factlake.llm.quality import quality_scores
from factlake.llm.secrets import joined, labelled_samples, log_ratios, secret_spans
from factlake.llm.sharding import histogram_shards
from factlake.llm.substrings import substring_dedup
from factlake.llm.token_counts import token_counts
from factlake.llm.warc import warc_round_trip

TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 1024


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts(docs, tokenizer_path(), fresh_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), least AS (
  SELECT g, min(doc_id) AS m FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT windows.doc_id, i, unnest(generate_series(0, 12)) AS k FROM windows JOIN least USING (g) WHERE m < windows.doc_id)
), gone_by AS (
  SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), kept AS (
  SELECT flat.doc_id, string_agg(word, ' ' ORDER BY flat.i) AS t
  FROM flat LEFT JOIN gone ON gone.doc_id = flat.doc_id AND gone.p = flat.i WHERE gone.p IS NULL GROUP BY flat.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(len(gone_by.p), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM words LEFT JOIN gone_by USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS position
  FROM documents
), keyed AS (
  SELECT doc_id, line, position,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, hot.key IS NOT NULL AS dropped FROM keyed LEFT JOIN hot USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"), whole=True)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the digest is taken before the exchange, so that the query's exchange carries no text
    placed = histogram_shards(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(id):
    return F.coalesce(F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), usable=lambda id: ~held_out(id))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_round_trip(pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM g
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_fingerprints(docs)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, tokenizer_path())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    codes, books = vector_codes(vectors, parts=16, entries=64, rounds=2)
    return codes.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int) -> str:
    """The rounds one after another: distances of all parts to all entries, the least, the entries' floors of means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f""", away{r} AS (
  SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cut c JOIN book{r} b USING (part, j) GROUP BY c.vec_id, c.part, b.entry
), near{r} AS (
  SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM away{r} GROUP BY vec_id, part
)""")
        if r < rounds:
            steps.append(f""", book{r + 1} AS (
  SELECT b.part, b.entry, b.j, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT n.part, n.entry, c.j, sum(c.x) // count(*) - CASE WHEN sum(c.x) % count(*) < 0 THEN 1 ELSE 0 END AS x FROM near{r} n JOIN cut c USING (vec_id, part) GROUP BY n.part, n.entry, c.j
  ) m USING (part, entry, j)
)""")
    return "".join(steps)


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT vec_id, (i - 1) // w AS part, (i - 1) % w AS j, CAST(floor(256 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, e, len(e) // 16 AS w, unnest(generate_series(1, len(e))) AS i FROM kept)
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (
  SELECT part, entry, j, x FROM cut JOIN seeds USING (vec_id)
){_lloyd_sql(2)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (vec_id)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), hashes AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units
), forms AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashes
), pieces AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM forms
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs, log_ratios(labelled_samples(docs)))
    n = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x.kind.isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_sharding": op6_sharding,
    "op8_quality": op8_quality,
    "op7_warc": op7_warc,
    "op9_fingerprints": op9_fingerprints,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_secrets": op13_secrets,
}
ORACLES: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
