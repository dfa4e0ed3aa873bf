"""Queries of the corpus operators, one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barcraft.llm.collocations import LEAST, LONGEST, PERCENT, TOP, collocations
from barcraft.llm.decontaminate import SLOP, contamination, listed
from barcraft.llm.decontaminate import WINDOW as ITEM_WINDOW
from barcraft.llm.language import identify
from barcraft.llm.main_text import main_text
from barcraft.llm.mixing import mix
from barcraft.llm.near_dedup import near_duplicates
from barcraft.llm.quality import BASE_PERCENT, BASE_WINDOW, GRAM_PERCENT, LINE_PERCENT, MIN_WORDS, repetition_quality
from barcraft.llm.sharding import SHARD_BYTES, shards
from barcraft.llm.substring_dedup import WINDOW, substring_dedup
from barcraft.llm.token_output import token_files
from barcraft.llm.toxicity import toxicity
from barcraft.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes
from barcraft.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"))


def op3_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(_table(spark, sf_dir, "documents"))


def op4_superkmer_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op5_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op6_arrow_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_files(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op7_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: listed(F.col(c)) for c in ("matches", "near_matches")})


def op8_min_cost_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc_dictionary_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op11_suffix_array_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_template_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op13_elkan_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_extendible_hash_shards": op2_extendible_hash_shards,
    "op3_repetition_quality": op3_repetition_quality,
    "op4_superkmer_substring_dedup": op4_superkmer_substring_dedup,
    "op5_word_backoff_language": op5_word_backoff_language,
    "op6_arrow_token_files": op6_arrow_token_files,
    "op7_positional_index_decontamination": op7_positional_index_decontamination,
    "op8_min_cost_flow_mixing": op8_min_cost_flow_mixing,
    "op9_cnn_toxicity": op9_cnn_toxicity,
    "op10_warc_dictionary_archive": op10_warc_dictionary_archive,
    "op11_suffix_array_collocations": op11_suffix_array_collocations,
    "op12_template_main_text": op12_template_main_text,
    "op13_elkan_vector_codes": op13_elkan_vector_codes,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"



def _covered(n: int) -> str:
    """Words under n-grams that a text holds twice or more, as (doc_id, i)."""
    return f"""
  SELECT DISTINCT doc_id, p + unnest(range(0, {n})) AS i FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
      SELECT doc_id, p, array_to_string(ws[p:p + {n - 1}], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS p FROM w WHERE len(ws) >= {n}))) WHERE c > 1"""


_GRAM_TABLES = ",\n".join(
    f"g{n} AS MATERIALIZED (SELECT c.doc_id, sum(length(w.ws[c.i])) AS chars, count(*) AS words FROM ({_covered(n)}) c JOIN w USING (doc_id) GROUP BY 1)" for n in GRAM_PERCENT
)
_GRAM_COLUMNS = ", ".join(f"coalesce(g{n}.chars, 0)::BIGINT AS dup{n}_chars" for n in GRAM_PERCENT)
_GRAM_JOINS = " ".join(f"LEFT JOIN g{n} USING (doc_id)" for n in GRAM_PERCENT)
_GRAM_RULES = " AND ".join(f"100 * dup{n}_chars <= {most} * word_chars" for n, most in GRAM_PERCENT.items())

_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

#: Pages of the table name their article, and their text has these character references only.
_ARTICLE = "regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*)</article>', 1), '(\\s|<br>)+', ' ', 'g')"
_LINES = f"string_split(regexp_replace(regexp_replace({_ARTICLE}, '</?(p|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10))"
_DECODED = "replace(replace(replace(x, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"


def _lloyd_round(r: int) -> str:
    """Assignment to the codebook b{r} and, but for the last, the codebook after it."""
    assigned = f"""a{r} AS MATERIALIZED (SELECT id, p, (m % {ENTRIES})::INT AS e, (m // {ENTRIES})::BIGINT AS d FROM (
  SELECT x.id, p, min({ENTRIES} * list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + b.e) AS m FROM x JOIN b{r} b USING (p) GROUP BY x.id, p))"""
    if r == ROUNDS:
        return assigned
    return assigned + f""",
s{r} AS (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{r} JOIN x USING (id, p)) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY p, e) n USING (p, e))"""


ORACLES: dict[str, str] = {
    "op12_template_main_text": f"""
WITH t AS (SELECT page_id, url, array_to_string(list_filter(list_transform({_LINES}, lambda x:
  trim(regexp_replace(regexp_replace({_DECODED}, '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM pages)
SELECT page_id, url, text, length(text) AS n_chars FROM t
""",
    "op11_suffix_array_collocations": rf"""
WITH t AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[p:p + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM t, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(ws) >= k) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM t GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
cut AS (SELECT *, array_to_string(ws[:i], ' ') AS x, array_to_string(ws[i + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT cut.*, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = cut.x JOIN g y ON y.lang = cut.lang AND y.phrase = cut.y JOIN n ON n.lang = cut.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM s),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[p:p + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS p FROM (SELECT *, unnest(range(2, k)) AS m FROM c)))
  GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE nth = 1 AND (longer IS NULL OR 100 * longer < {PERCENT} * a))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= {TOP}
""",
    "op13_elkan_vector_codes": f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS id FROM k),
x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS v FROM o, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, id AS e, v FROM x WHERE id < {ENTRIES}),
{(chr(44) + chr(10)).join(_lloyd_round(r) for r in range(ROUNDS + 1))},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN c USING (id), h
""",
    "op2_extendible_hash_shards": f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(DISTINCT h) AS keys
  FROM d, (SELECT unnest(range(0, 40)) AS depth) GROUP BY 1, 2),
f AS (
  SELECT d.doc_id, d.n_bytes, s.*, row_number() OVER (PARTITION BY d.h, d.doc_id ORDER BY s.depth) AS nth
  FROM d JOIN s ON s.prefix = d.h >> (60 - s.depth) WHERE s.shard_bytes <= {SHARD_BYTES} OR s.keys = 1)
SELECT doc_id, n_bytes, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth::INT AS depth, shard_bytes
FROM f WHERE nth = 1
""",
    "op10_warc_dictionary_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(x) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (h)
""",
    "op7_positional_index_decontamination": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_TOKEN}'), []) AS ws FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '{_TOKEN}'), []) AS ws FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), {ITEM_WINDOW}) AS n, array_to_string(ws[p:p + {ITEM_WINDOW - 1}], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {ITEM_WINDOW} + 1, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, n WHERE len(ws) >= n)),
hits AS MATERIALIZED (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
m AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS matches FROM (SELECT DISTINCT doc_id, item_id::VARCHAR || ':' || (p - 1) || ':' || n AS x FROM hits) GROUP BY 1),
t AS MATERIALIZED (SELECT doc_id, ws[i] AS term, i - 1 AS pos FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
tf AS (SELECT term, count(*) AS c FROM t GROUP BY 1),
ph AS MATERIALIZED (SELECT DISTINCT g, n, string_split(g, ' ') AS ws FROM bw),
pt AS (SELECT g, n, term, pos, row_number() OVER (PARTITION BY g ORDER BY coalesce(c, 0), term, pos) AS nth
  FROM (SELECT g, n, ws[i] AS term, i - 1 AS pos FROM (SELECT g, n, ws, unnest(range(1, n + 1)) AS i FROM ph)) LEFT JOIN tf USING (term)),
rare AS MATERIALIZED (SELECT a.g, a.n, a.term AS t1, a.pos AS p1, coalesce(b.term, a.term) AS t2, coalesce(b.pos, a.pos) AS p2
  FROM (SELECT * FROM pt WHERE nth = 1) a LEFT JOIN (SELECT * FROM pt WHERE nth = 2) b ON a.g = b.g),
cand AS (SELECT DISTINCT x.doc_id, r.g, r.n, x.pos - p1 AS start FROM rare r JOIN t x ON x.term = t1 JOIN t y ON y.term = t2 AND y.doc_id = x.doc_id
  WHERE x.pos - p1 >= -{SLOP} AND abs((x.pos - p1) - (y.pos - p2)) <= {SLOP}),
near AS (SELECT DISTINCT c.doc_id, bw.item_id::VARCHAR || ':' || c.start || ':' || c.n AS x FROM cand c JOIN d USING (doc_id) JOIN bw ON bw.g = c.g
  WHERE list_has_all(d.ws[greatest(c.start - {SLOP}, 0) + 1:c.start + c.n + {SLOP}], string_split(c.g, ' '))
  AND array_to_string(CASE WHEN c.start >= 0 THEN d.ws[c.start + 1:c.start + c.n] ELSE [] END, ' ') <> c.g),
nm AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS near_matches FROM near GROUP BY 1),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, p + unnest(range(0, n)) AS i FROM hits) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(matches, '') AS matches, coalesce(near_matches, '') AS near_matches
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN nm USING (doc_id)
""",
    "op3_repetition_quality": rf"""
WITH w AS MATERIALIZED (SELECT doc_id, text, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[ 	-
]+', '', 'g'))) AS chars FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w))
  WHERE nth > 1 AND regexp_matches(line, '{_WORD}') GROUP BY 1),
{_GRAM_TABLES},
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
    coalesce(g{BASE_WINDOW}.words, 0) AS n_repeat_words, coalesce(l.chars, 0)::BIGINT AS dup_line_chars, {_GRAM_COLUMNS}
  FROM w LEFT JOIN l USING (doc_id) {_GRAM_JOINS})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words)
  AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars AND {_GRAM_RULES} AS kept FROM m
""",
    "op4_superkmer_substring_dedup": rf"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS p FROM w WHERE len(ws) >= {WINDOW})),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth FROM g),
c AS MATERIALIZED (SELECT DISTINCT doc_id, p + unnest(range(0, {WINDOW})) AS i FROM r WHERE nth > 1),
gone AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
""",
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
}
