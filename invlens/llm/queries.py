"""One query per operator over its whole table, the pipeline's query, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invlens.llm import chat, decontamination, hard_negatives, jaccard_join, licenses, nearest, packing, spelling, substring_dedup, token_files, toxicity, warc, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""
    return winnowing.compare_with_next(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every text."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every text once windows repeated from smaller documents are gone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts, written and read back."""
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.formatted_conversations(_table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose shingle sets are alike to 0.8 or more."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return nearest.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of every 100th vector."""
    return hard_negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted word with its near words, form and root."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline``, over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_winnowing, op2_license_scan, op3_toxicity, op4_substring_dedup, op5_token_files, op6_chat_snapshots, op7_packing, op8_jaccard_join, op9_warc, op10_decontamination, op11_nearest, op12_hard_negatives, op13_spelling, pipeline)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = licenses.UPPER, licenses.LOWER

_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
own AS (SELECT h, min(doc_id) AS o FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN own USING (h) WHERE o < doc_id), range(0, 50) r(j)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

_OP6 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER o AS so_far,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER o AS rendered
    FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT *, min(conv_id) OVER (PARTITION BY so_far) AS copy_of FROM s WHERE pos = n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, copy_of, rendered FROM whole WHERE so_far NOT IN (SELECT so_far FROM s WHERE pos < n)"""

_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, md5(unnest(s)) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = n.doc_id"""

_OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
    CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM m"""

_OP10 = rf"""
WITH x AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{licenses.WORD}') AS w FROM x),
s AS (SELECT DISTINCT kind, id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
i AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 1),
short AS (SELECT id, array_to_string(w, ' ') AS s FROM w WHERE kind = 1 AND len(w) BETWEEN 1 AND 4)
SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n) AS item_shingles, count(*) AS shared, count(*) / any_value(i.n) AS containment
FROM i JOIN s d ON d.kind = 0 AND d.s = i.s GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)
UNION ALL
SELECT w.id, short.id, 1, 1, 1.0 FROM w JOIN short ON w.kind = 0 AND contains(' ' || array_to_string(w.w, ' ') || ' ', ' ' || short.s || ' ')"""


_OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) <= 5"""

_OP13 = rf"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
run AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'), lambda x: translate(x, '{_UPPER}', '{_LOWER}'))) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
byte AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)) AS b FROM run),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM byte, tab),
word AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.d UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.d),
best AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY v.n DESC, near) AS near, max(v.n) AS m FROM p JOIN v ON v.word = p.near GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at AND e.form IS NULL"""


def oracle() -> dict[str, str]:
    """SQL for the queries whose whole result SQL can express; the others have brute-force tests."""
    return {"op2_license_scan": licenses.scan_sql(), "op4_substring_dedup": _OP4, "op6_chat_snapshots": _OP6, "op8_jaccard_join": _OP8, "op9_warc": _OP9, "op10_decontamination": _OP10, "op12_hard_negatives": _OP12, "op13_spelling": _OP13}
