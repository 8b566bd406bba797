"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.common import registry
from ..sources.tables import table
from .bpe import decode, encode
from .compression import quality_scores
from .exact import exact_duplicates
from .fm_index import remove_substrings
from .minhash import near_duplicates
from .packing import pack
from .phrases import mine_phrases
from .resample import resample
from .rules import apply_rules
from .simhash import simhash_duplicates
from .suffixes import remove_repeats
from .toxicity import toxicity_scores
from .urls import filter_urls

QUERIES, SQL, query = registry()

# DuckDB: lower-case A-Z only.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def repeats_sql(window: int) -> str:
    """Windows of every text, counted by their words."""
    return f"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {window - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM split)),
hit AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM hit),
flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM flat ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)"""


@query()
def op1_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 1024 ids, neighbours on the curve together."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query()
def op2_quality_rules(spark, sf_dir):
    """Base counts of every document and the verdict of the certified rules."""
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "stratum", "rejected_by")


@query()
def op3_byte_bpe(spark, sf_dir):
    """Digests of the ids of every document and of the bytes they decode to."""
    return decode(encode(table(spark, sf_dir, "documents")), digest=True)


@query(repeats_sql(35))
def op4_substring_dedup(spark, sf_dir):
    """Every document without the words of windows of 35 words that occur twice."""
    return remove_substrings(table(spark, sf_dir, "documents"), digest=True)


@query("""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*', 0)) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    regexp_matches(host, '(^|[.-])(spam|casino|pills|bets|adult|ads)([.-]|$)') AS listed
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
""")
def op5_url_filter(spark, sf_dir):
    """Rule and verdict of every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"))


@query()
def op6_toxicity(spark, sf_dir):
    """Toxicity of every document and the spans it comes from."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id,
       d.doc_id = min(b) AS kept
FROM documents d JOIN reach ON d.doc_id = a LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""")
def op7_near_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents, and which document of each stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(f"""
WITH texts AS (SELECT doc_id, {LOWER} AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(t) AS text_sha256
FROM texts JOIN groups USING (t)
""")
def op8_exact_dedup(spark, sf_dir):
    """Copies of every text, and which of them stays."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("bucket")


@query()
def op9_quality_classifier(spark, sf_dir):
    """Quality of every document by the compression classifier."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(repeats_sql(50))
def op10_suffix_dedup(spark, sf_dir):
    """Every document without the words of windows of 50 words that occur twice."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query(f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM split GROUP BY lang),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
runs AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM spots, range(1, 6) t(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS c, string_split(phrase, ' ') AS ws FROM runs GROUP BY lang, k, phrase
      HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, c, ws, j, array_to_string(ws[:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp
  FROM f, range(1, 5) t(j) WHERE k > 1 AND j < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.c AS a, j, x.c AS l, y.c AS r, n,
         1000::HUGEINT * cuts.c::HUGEINT * n::HUGEINT // (x.c::HUGEINT * y.c::HUGEINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp
  JOIN totals t ON t.lang = cuts.lang),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(c) AS longer
  FROM f, range(2, 5) a(m), range(1, 5) b(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""")
def op11_phrases(spark, sf_dir):
    """The best phrases of every language."""
    return mine_phrases(table(spark, sf_dir, "documents"))


# The generator of CRC-32, bits reversed.
CRC = "3988292384"


@query(f"""
WITH texts AS (
  SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
split AS (
  SELECT row_number() OVER () AS row, doc_id, side,
         list_filter(string_split_regex({LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws
  FROM texts),
spots AS (SELECT row, side, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
features AS (
  SELECT row, side, array_to_string(ws[i:i + k - 1], ' ') AS f FROM spots, range(1, 4) t(k) WHERE i + k - 1 <= len(ws)),
step AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * {CRC})) ORDER BY b) AS tab
  FROM (SELECT unnest(range(256)) AS b)),
bytes AS (
  SELECT f, list_transform(string_split(trim(regexp_replace(hex(encode(f)), '(..)', '\\1 ', 'g')), ' '),
    lambda x: 16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1) AS bs
  FROM (SELECT DISTINCT f FROM features)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])),
                4294967295) % 10000 AS b FROM bytes, step),
counts AS (
  SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN buckets USING (f) GROUP BY b),
sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (
  SELECT b, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, sums),
weights AS (
  SELECT row, count(*) AS n_features, sum(gain) AS weight
  FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
           CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (row) WHERE side = 0),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
       CAST(score AS BIGINT) AS score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
""")
def op12_resample(spark, sf_dir):
    """A draw of five in a hundred documents whose features look like the benchmark's."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_simhash(spark, sf_dir):
    """Fingerprints of all documents and the classes that links of two bits or fewer make."""
    return simhash_duplicates(table(spark, sf_dir, "documents"))
