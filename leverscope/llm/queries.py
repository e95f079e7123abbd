"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from leverscope.llm import (
    chat, common, decontamination, divergence, language, language_model, near_duplicates, packing, privacy, quality, sharding, structure, token_counts, vectors,
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_role_repair(spark, sf_dir):
    return chat.repair(common.table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH RECURSIVE d AS (SELECT conv_id, turn, role, text, count(*) AS copies FROM conversations GROUP BY ALL),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS position,
    count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN lower(trim(role)) = 'system' THEN 0 WHEN lower(trim(role)) IN ('user', 'human', 'prompter') THEN 1
         WHEN lower(trim(role)) IN ('assistant', 'bot', 'gpt', 'model', 'ai') THEN 2 ELSE 3 END AS seen FROM d),
c AS (SELECT *, CASE seen WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 3 END AS l0, CASE seen WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 3 END AS l1,
        CASE seen WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 3 END AS l2 FROM t),
f AS (
  SELECT conv_id, position, l0 AS s, l1 AS u, 2 + l2 AS a FROM c WHERE position = 0
  UNION ALL
  SELECT c.conv_id, c.position, f.s + 1 + l0, least(f.s, f.u + 1, f.a) + l1, least(f.s + 2, f.u, f.a + 1) + l2
  FROM f JOIN c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.position = f.position + 1),
g AS (
  SELECT f.conv_id, f.position, CASE WHEN f.s + 4 <= least(f.u + 2, f.a) THEN 0 WHEN f.u + 2 <= f.a THEN 1 ELSE 2 END AS o
  FROM f JOIN c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.position = f.position AND c.n = c.position + 1
  UNION ALL
  SELECT f.conv_id, f.position, CASE
    WHEN g.o = 0 THEN 0
    WHEN g.o = 1 THEN CASE WHEN f.s <= least(f.u + 1, f.a) THEN 0 WHEN f.u + 1 <= f.a THEN 1 ELSE 2 END
    ELSE CASE WHEN f.s + 2 <= least(f.u, f.a + 1) THEN 0 WHEN f.u <= f.a + 1 THEN 1 ELSE 2 END END
  FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.position = g.position - 1),
r AS (
  SELECT c.*, g.o, coalesce(p.o, 3) AS b, ['system', 'user', 'assistant'][g.o + 1] AS name, c.n = c.position + 1 AS ends
  FROM c JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.position = c.position
  LEFT JOIN g p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.position = c.position - 1)
SELECT conv_id, position, turn, role, name AS role_out,
  CASE WHEN b = o THEN 'merge' WHEN seen <> o THEN 'relabel' ELSE 'keep' END AS action,
  concat_ws(',', CASE WHEN b IN (0, 3) AND o = 2 THEN 'user' END,
    CASE WHEN ends AND o = 0 THEN 'user,assistant' WHEN ends AND o = 1 THEN 'assistant' END) AS inserted, copies,
  CASE WHEN b = o THEN E'\n\n' ELSE concat(CASE WHEN b <> 3 THEN E'<|im_end|>\n' END,
    CASE WHEN b IN (0, 3) AND o = 2 THEN E'<|im_start|>user\n<|im_end|>\n' END, '<|im_start|>', name, E'\n') END
  || replace(coalesce(text, ''), '<|', '< |')
  || CASE WHEN NOT ends THEN '' ELSE concat(E'<|im_end|>\n', CASE WHEN o = 0 THEN E'<|im_start|>user\n<|im_end|>\n' END,
       CASE WHEN o < 2 THEN E'<|im_start|>assistant\n<|im_end|>\n' END) END AS piece
FROM r
"""


def op2_quality_pu(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.fold(F.col("doc_id"), 5) == 0
    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1").filter(~held_out)
    scored = quality.score(docs, quality.learn(docs.filter(~held_out), trusted))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_language_id(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = language.learn(docs.filter(~held_out))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_skip_chain_crf(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.tag(docs, privacy.learn(docs)).drop("redacted")


def op5_packing(spark, sf_dir):
    pieces = packing.pack(common.table(spark, sf_dir, "documents"), VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op6_itq(spark, sf_dir):
    return vectors.near_vectors(common.table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, e.vec_id) AS component_id, e.vec_id = coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON least.x = e.vec_id LEFT JOIN counted ON counted.x = e.vec_id
"""


def op7_kd_shards(spark, sf_dir):
    return sharding.kd_shards(common.table(spark, sf_dir, "documents"), shards=8)


def op8_minhash_forest(spark, sf_dir):
    return near_duplicates.near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85).drop("row")


def op9_qgram_lemma(spark, sf_dir):
    return decontamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, md5(array_to_string(unnest(s), ' ')) AS h FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON x = doc_id
"""


def op10_kneser_ney(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.fold(F.col("doc_id"), 5) == 1
    scored = language_model.score(docs, language_model.learn(docs.filter(~held_out)))
    return scored.withColumn("held_out", held_out)


def op11_heap_bpe_count(spark, sf_dir):
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), PIECES)


def op12_structure_alignment(spark, sf_dir):
    return structure.audit(common.table(spark, sf_dir, "conversations"))


# Costs to go of the four states of the grammar (nothing yet, system, user, assistant), from the last row backwards.
OP12_SQL = r"""
WITH RECURSIVE
bit AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS s FROM range(256) x(i)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM bit WHERE s < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE s = 8),
d AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''),
          lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::INTEGER])), 4294967295::BIGINT) % 20 AS draw
      FROM conversations, tab),
r AS (SELECT cid, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM d WHERE draw <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY cid) AS n,
        row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM r),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS ro,
        i > 1 AND concat(lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i), left(role, 1)) NOT IN ('su', 'ua', 'au') AS odd FROM p),
g AS (SELECT *, (fault = 'truncated')::INTEGER AS e, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS no FROM f),
v AS (
  SELECT DISTINCT cid, n + 1 AS i, 0::BIGINT AS v0, 4::BIGINT AS v1, 2::BIGINT AS v2, 0::BIGINT AS v3 FROM g
  UNION ALL
  SELECT cid, i, least(w0, 2 + w2, 4 + w3), least(w1, 2 + w2, 4 + w3), least(w2, 2 + w3), least(w3, 2 + w2) FROM (
    SELECT g.cid, g.i,
      least(3 + v0, no + e + v2 + CASE ro WHEN 2 THEN 0 ELSE 2 END, no + e + CASE ro WHEN 1 THEN v1 ELSE 1000000000 END) AS w0,
      least(3 + v1, no + e + v2 + CASE ro WHEN 2 THEN 0 ELSE 2 END) AS w1,
      least(3 + v2, no + e + v3 + CASE ro WHEN 3 THEN 0 ELSE 2 END) AS w2,
      least(3 + v3, no + e + v2 + CASE ro WHEN 2 THEN 0 ELSE 2 END) AS w3
    FROM v JOIN g ON g.cid = v.cid AND g.i = v.i - 1)),
edit AS (SELECT * FROM (VALUES (0, 'D', 1), (1, 'D', 2), (2, 'D', 3), (2, 'K', 4), (2, 'R', 5), (1, 'K', 6), (1, 'R', 7), (0, 'K', 8), (0, 'R', 9)) x(t, letter, ord)),
q AS (SELECT unnest([0, 1, 2, 3]) AS q, unnest([2, 2, 3, 2]) AS nx, unnest([3, 3, 2, 3]) AS nx2),
o AS (
  SELECT g.cid, g.i, q, t, letter, ord, [v0, v1, v2, v3][q + 1] AS need, no, e, ro, t * 2 AS c, CASE t WHEN 0 THEN q WHEN 1 THEN nx ELSE nx2 END AS q1
  FROM g JOIN v ON v.cid = g.cid AND v.i = g.i, q, edit),
o2 AS (SELECT *, CASE q1 WHEN 2 THEN 3 ELSE 2 END AS nq FROM o),
o3 AS (
  SELECT *, CASE WHEN letter = 'D' THEN q1 WHEN letter = 'R' THEN nq WHEN ro = 1 AND q1 = 0 THEN 1 WHEN ro = nq THEN nq END AS to_,
    c + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN no + 2 + e ELSE no + e END AS paid FROM o2),
best AS (
  SELECT o3.cid, o3.i, q, arg_min({'t': t, 'letter': letter, 'to_': to_}, ord) AS x
  FROM o3 JOIN v ON v.cid = o3.cid AND v.i = o3.i + 1 WHERE to_ IS NOT NULL AND paid + [v0, v1, v2, v3][to_ + 1] = need GROUP BY ALL),
way AS (
  SELECT cid, i, q, x FROM best WHERE i = 1 AND q = 0
  UNION ALL
  SELECT b.cid, b.i, b.q, b.x FROM way w JOIN best b ON b.cid = w.cid AND b.i = w.i + 1 AND b.q = w.x.to_),
piece AS (
  SELECT w.cid, w.i, repeat('I', w.x.t) || w.x.letter AS letters,
    list_concat(list_transform(range(w.x.t), lambda k: CASE WHEN (w.q = 2) = (k = 0) THEN 'assistant:' ELSE 'user:' END),
      CASE w.x.letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE w.x.to_ WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END) AS lines
  FROM way w JOIN g ON g.cid = w.cid AND g.i = w.i
  UNION ALL
  SELECT w.cid, w.i + 1, CASE w.x.to_ WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, CASE w.x.to_ WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END
  FROM way w JOIN g ON g.cid = w.cid AND g.i = w.i AND g.i = g.n),
done AS (SELECT cid, string_agg(letters, '' ORDER BY i) AS audit, sha256(array_to_string(flatten(list(lines ORDER BY i)), E'\n')) AS digest FROM piece GROUP BY cid),
sums AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM g GROUP BY cid)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM d) a LEFT JOIN sums ON sums.cid = a.cid LEFT JOIN v ON v.cid = a.cid AND v.i = 1 LEFT JOIN done ON done.cid = a.cid
"""


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS l_n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, l_n, coalesce(n, 0) AS n FROM g JOIN k ON k.lang = g.lang
      LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p,
        1 + 1000000000::HUGEINT * (l_n + 1) // (sum(l_n) OVER w + count(*) OVER w) AS q FROM c WINDOW w AS (PARTITION BY lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200
"""


ENTRIES = {
    "op11_heap_bpe_count": (op11_heap_bpe_count, None),
    "op12_structure_alignment": (op12_structure_alignment, OP12_SQL),
    "op13_source_divergence": (op13_source_divergence, OP13_SQL),
    "op1_role_repair": (op1_role_repair, OP1_SQL),
    "op6_itq": (op6_itq, OP6_SQL),
    "op4_skip_chain_crf": (op4_skip_chain_crf, None),
    "op2_quality_pu": (op2_quality_pu, None),
    "op9_qgram_lemma": (op9_qgram_lemma, None),
    "op10_kneser_ney": (op10_kneser_ney, None),
    "op8_minhash_forest": (op8_minhash_forest, OP8_SQL),
    "op3_language_id": (op3_language_id, None),
    "op5_packing": (op5_packing, None),
    "op7_kd_shards": (op7_kd_shards, None),
}
