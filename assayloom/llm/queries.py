"""The op queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    from .packing import pack, tokenize_pieces

    return pack(tokenize_pieces(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), "byte", 2048, 0, cache_size=1_800_000), 2048)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every text, its edited text and the next document."""
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text that repeat passages of 13 words from documents with smaller ids."""
    from .substrings import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).drop("repeats")


_A_TO_Z = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS k FROM documents),
s AS (SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(coalesce(doc_id, 9223372036854775807)) AS first FROM s GROUP BY g),
r AS (SELECT DISTINCT k, i + o AS i FROM s JOIN m USING (g), range(13) t(o) WHERE first < coalesce(doc_id, 9223372036854775807)),
e AS (SELECT k, list(i) AS gone FROM r GROUP BY k),
f AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN e USING (k))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL), ' ')) AS kept_sha256
FROM f
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of each document."""
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
f AS (SELECT level FROM o WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least((SELECT level FROM f) * w, CAST(cap AS DOUBLE)) AS target FROM o),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM t),
e AS (SELECT *, CAST(sum(goal) OVER (ORDER BY s) AS BIGINT) AS c, CAST(sum(goal) OVER () AS BIGINT) AS total FROM g),
z AS (SELECT s, goal, CAST(c AS DOUBLE) / total AS hi, CAST(c - goal AS DOUBLE) / total AS lo FROM e WHERE goal > 0),
i AS (SELECT id, (id + 1) * 0.6180339887498949::DOUBLE - floor((id + 1) * 0.6180339887498949::DOUBLE) AS p FROM range((SELECT CAST((sum(goal) + 511) // 512 AS BIGINT) FROM g)) r(id)),
a AS (SELECT s, id AS slot, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS r FROM i JOIN z ON lo <= p AND p < hi),
n AS (SELECT g.s, (goal + 511) // 512 AS need, (SELECT count(*) FROM a WHERE a.s = g.s) AS have FROM g),
l AS (SELECT s, have, need, coalesce(sum(need - have) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE have < need),
b AS (SELECT s, r, slot FROM a UNION ALL SELECT s, r, (SELECT count(*) FROM i) + before - have + r FROM l, unnest(range(have, need)) u(r)),
p AS (
  SELECT d.doc_id, d.size, g.s, g.source_size, g.target, g.goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(0, least(size, goal % source_size - pos)) END AS taken,
       CASE WHEN size > 0 AND goal > pos THEN CAST(slot AS BIGINT) END AS first_slot
FROM p LEFT JOIN b ON b.s = p.s AND b.r = p.pos // 512
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles are 80 % alike."""
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=80)


OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_A_TO_Z}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON x = doc_id LEFT JOIN n USING (doc_id)
"""


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries and checksums of all documents, read back from the token files."""
    from .common import tables_dir
    from .token_files import read_token_files, write_token_files

    # among the intermediate tables, which drop_tables() removes
    out = f"{tables_dir(spark)}/token_files_{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), out, _vocabulary("word_bpe_49k.json"), "word", 2)
    return read_token_files(spark, out)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the patterns' counts and all spans."""
    from .pii import find, fit

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs)).drop("text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every text."""
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label with cosine 0.98 or more."""
    from .vector_dup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v
      WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON x = vec_id LEFT JOIN k ON a = vec_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a network trained on labelled rows outside the held-out fifth."""
    from .quality import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text that five documents or more share, dropped but in the last one."""
    from .lines import line_dedup

    kept = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40, 5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w, row_number() OVER () AS k FROM documents),
l AS (SELECT k, doc_id, i, translate(trim(w[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 5),
g AS (SELECT k, list(i) AS gone FROM l JOIN f USING (key) WHERE doc_id IS DISTINCT FROM last GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), chr(10))) AS kept_sha256
FROM d LEFT JOIN g USING (k)
"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the repaired text's hash."""
    from .conversations import report

    return report(_table(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a short ASCII text, bit by bit."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)::BIGINT[]), lambda x, y: {bit})), 4294967295)"


# the rows are taken forwards, with the best (cost, audit) for each state of the roles' grammar
OP12_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how
  FROM conversations),
d AS (
  SELECT k, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, range(2) x(copy) WHERE how <> 0 AND (copy = 0 OR how = 3)),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS seen FROM b),
r AS (
  SELECT *, left(role, 1) AS a, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM o),
t AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate,
         count(*) FILTER (WHERE f = 3) AS truncated, count(*) FILTER (WHERE bad) AS illegal, max(i) AS n
  FROM r GROUP BY k),
ins(q, p, s, roles) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']),
  (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
kept(q, a, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
v AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS said FROM t
  UNION ALL
  SELECT k, i, q, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY k, i, q ORDER BY cost, audit) AS best FROM (
      SELECT v.k, r.i, e.q, v.cost + 3 * length(ins.s) + e.w + CASE WHEN e.l <> 'D' AND r.f = 3 THEN 3 ELSE 0 END AS cost, v.audit || ins.s || e.l AS audit,
             list_concat(list_concat(v.said, ins.roles), e.say) AS said
      FROM v JOIN r ON r.k = v.k AND r.i = v.i + 1 JOIN ins ON ins.q = v.q LEFT JOIN kept ON kept.q = ins.p AND kept.a = r.a,
      LATERAL (SELECT 'D' AS l, 4 AS w, ins.p AS q, []::VARCHAR[] AS say
               UNION ALL SELECT 'K', 0, kept.p, [r.role || ':' || r.text] WHERE kept.p IS NOT NULL AND r.f NOT IN (1, 2)
               UNION ALL SELECT 'R', 3, CASE ins.p WHEN 2 THEN 3 ELSE 2 END, [CASE ins.p WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text] WHERE r.f NOT IN (1, 2)) e))
  WHERE best = 1),
z AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY cost, audit) AS best FROM (
    SELECT v.k, v.cost + 3 * length(ins.s) AS cost, v.audit || ins.s AS audit, list_concat(v.said, ins.roles) AS said
    FROM v JOIN t ON t.k = v.k AND t.n = v.i JOIN ins ON ins.q = v.q AND ins.p IN (0, 3)))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k FROM conversations) LEFT JOIN t USING (k) LEFT JOIN (SELECT * FROM z WHERE best = 1) USING (k)
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of a Merkle tree by language, with its proof checked after some rows were tampered with."""
    from .merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]).drop("proof")


def _leaf_sql(n_chars: str) -> str:
    part = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({v} AS VARCHAR))) AS VARCHAR) || ':' || CAST({v} AS VARCHAR) END"
    return "sha256(" + " || ".join(part(c, n_chars if c == "n_chars" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


# trees 1, 2, ... are the languages' and tree 0 is that of their subroots
OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS t, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 AND doc_id IS NOT NULL THEN {_leaf_sql("n_chars + 1")} ELSE leaf END AS used
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
v AS (
  SELECT t, CAST(0 AS BIGINT) AS k, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM p
  UNION ALL
  SELECT t, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM v WHERE n > 1 GROUP BY t, k, i // 2, n),
s AS (SELECT t, h AS subroot FROM v WHERE n = 1),
w AS (
  SELECT CAST(0 AS BIGINT) AS k, t - 1 AS i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM w WHERE n > 1 GROUP BY k, i // 2, n),
o AS (SELECT h AS root FROM w WHERE n = 1),
u AS (
  SELECT t, i, used, list({{'l': CASE WHEN a % 2 = 1 THEN b ELSE '' END, 'r': CASE WHEN a % 2 = 0 THEN coalesce(b, '') ELSE '' END}} ORDER BY z, k) FILTER (WHERE k IS NOT NULL) AS q
  FROM (
    SELECT p.t, p.i, p.used, 0 AS z, x.k, p.i >> x.k AS a, y.h AS b FROM p LEFT JOIN (SELECT DISTINCT t, k FROM v WHERE n > 1) x ON x.t = p.t LEFT JOIN v y ON y.t = p.t AND y.k = x.k AND y.i = xor(p.i >> x.k, 1)
    UNION ALL
    SELECT p.t, p.i, p.used, 1, x.k, (p.t - 1) >> x.k, y.h FROM p JOIN (SELECT DISTINCT k FROM w WHERE n > 1) x ON true LEFT JOIN w y ON y.k = x.k AND y.i = xor((p.t - 1) >> x.k, 1))
  GROUP BY t, i, used),
f AS (
  SELECT t, i, used AS h, coalesce(q, []) AS q, 1 AS j FROM u
  UNION ALL
  SELECT t, i, sha256(q[j].l || h || q[j].r), q, j + 1 FROM f WHERE j <= len(q))
SELECT p.doc_id, p.leaf, s.subroot, o.root, sha256(array_to_string(list_transform(f.q, lambda z: z.l || z.r), '')) AS proof_sha256, f.h AS folded_root, f.h = o.root AS verified
FROM p JOIN f ON f.t = p.t AND f.i = p.i AND f.j = len(f.q) + 1 JOIN s ON s.t = p.t, o
"""


QUERIES = {f.__name__: f for f in (op1_packing, op2_fingerprints, op3_substrings, op4_mixing, op5_near_duplicates, op6_token_files, op7_personal_data, op8_licenses, op9_near_vectors, op10_quality, op11_lines, op12_conversations, op13_manifest)}
ORACLES: dict[str, str] = {"op3_substrings": OP3_SQL, "op4_mixing": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op9_near_vectors": OP9_SQL, "op11_lines": OP11_SQL, "op12_conversations": OP12_SQL, "op13_manifest": OP13_SQL}
