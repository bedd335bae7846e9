"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, lines, minhash, packing, periodic, pieces, quality, repair, secrets, substrings, suffix_tree, token_files
from .common import documents, shared_dir


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot signatures of every whole text and its edited text, and how alike they and the next document's are."""
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts under a suffix tree learned from four fifths of them."""
    return suffix_tree.score_documents(documents(spark, sf_dir))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text from the lattice of its substrings, and what they decode to."""
    return pieces.report(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in sequences of at most 4096, by cost."""
    return packing.pack(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all kinds in every whole text; null texts are empty."""
    return secrets.report(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with its class of near duplicates (weighted Jaccard of five-word shingles of 0.8 or more)."""
    return minhash.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose key ten documents or more hold; rows equal in id and text are one document."""
    out = lines.dedup_lines(documents(spark, sf_dir), min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in order of their ids, written, read back and digested."""
    path = token_files.write_tokens(documents(spark, sf_dir), shared_dir(spark))
    return token_files.read_digests(spark, path)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words under a 20-word window that starts earlier in the corpus."""
    return substrings.report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, log-likelihood ratio and verdict of every whole text."""
    return quality.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages every conversation and repairs it: faults, cheapest edits and the hash of the repaired text."""
    return repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periodic runs of every whole text (one in ten edited to hold a long one), and the text without their repeats."""
    return periodic.report(documents(spark, sf_dir))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from three quarters of the labelled documents."""
    return language.report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_pieces": op3_pieces,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_files": op8_token_files,
    "op9_substrings": op9_substrings,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language": op13_language,
}

OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, text_lines, unnest(text_lines) AS line, generate_subscripts(text_lines, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS text_lines FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), covered AS (
  SELECT DISTINCT doc_id, i + j AS p FROM again, (SELECT unnest(range(0, 20)) AS j)
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
), gone AS (
  SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""

#: CRC-32 bit by bit; then the cheapest edits state by state, row after row.
OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 20 AS h FROM src, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT conv_id, turn, role, text, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial,
         row_number() OVER w - 1 AS i, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, trimmed = '' AS blank, trimmed <> '' AND seen AS duplicate, trimmed <> '' AND NOT seen AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM placed
), move(s, inserted, mid) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)
), put(mid, letter, initial, s2) AS (VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2),
  (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2)
), edit AS (
  SELECT s, inserted || letter AS letters, letter, initial, s2, length(inserted) * 3 + CASE letter WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END AS cost,
         CASE inserted WHEN '' THEN [] WHEN 'I' THEN [CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END] ELSE ['user:', 'assistant:'] END AS made,
         CASE WHEN s2 = 3 THEN 'assistant:' ELSE 'user:' END AS named
  FROM move JOIN put USING (mid)
), step AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT conv_id, i + 1, s2, cost, audit, lines FROM (
    SELECT p.conv_id, p.i, e.s2, p.cost + e.cost + CASE WHEN r.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost, p.audit || e.letters AS audit,
           p.lines || e.made || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.named || r.text] END AS lines,
           row_number() OVER (PARTITION BY p.conv_id, e.s2 ORDER BY p.cost + e.cost + CASE WHEN r.truncated AND e.letter <> 'D' THEN 3 ELSE 0 END, p.audit || e.letters) AS place
    FROM step p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i
    JOIN edit e ON e.s = p.s AND (e.letter = 'D' OR NOT r.blank AND NOT r.duplicate AND (e.letter = 'R' OR e.initial = r.initial))
  ) WHERE place = 1
), counts AS (
  SELECT c.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), ended AS (
  SELECT k.*, p.cost + 3 * length(more) AS cost, p.audit || more AS audit, p.lines || tail AS lines, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 3 * length(more), p.audit || more) AS place
  FROM step p JOIN (VALUES (0, '', []), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])) t(s, more, tail) USING (s)
  JOIN counts k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.n = p.i
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM ended WHERE place = 1
"""

#: Pairs of equal words by distance; their islands of consecutive places are the runs.
OP12_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))
), src AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), hashed AS (
  SELECT src.*, len(ws) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h FROM src, tab
), planned AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 1 + (n - CASE WHEN n > 0 THEN (h // 10) % n END) // (3 + (h // 10) % 8) AS p FROM hashed
), word AS (
  SELECT r, doc_id, i, ws[CASE WHEN i < a OR a IS NULL THEN i ELSE a + (i - a) % p END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM planned)
), pair AS (
  SELECT x.r, y.i - x.i AS q, x.i AS i FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND x.i < y.i
), stretch AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pair) GROUP BY r, q, island HAVING count(*) + q >= greatest(12, 2 * q)
), run AS (
  SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS place FROM run) WHERE place = 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM src LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept k USING (r)
"""

SQL: dict[str, str] = {"op7_line_dedup": OP7_SQL, "op9_substrings": OP9_SQL, "op11_repair": OP11_SQL, "op12_periodic_runs": OP12_SQL}
