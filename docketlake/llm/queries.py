"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import bpe, collocations, decontaminate, divergence, html, language, licences, near_dup, pii, rank_bpe, substrings, tool_calls, vectors
from docketlake.llm.base import read

#: Vocabulary file of op8: byte-level BPE without normaliser and prefix space.
TOKENIZER = "byte_bpe_50k.json"
#: Rank file of op13.
RANKS = "byte_bpe_50k.tiktoken"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.turn_calls(read(spark, sf_dir, "conversations")), tool_calls.REPLY)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()), "text", "lang")
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("base")
    return licences.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).alias("first_word"),
        F.array_max(base).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = rank_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_minhash_near_dup, op3_pii, op4_tool_calls, op5_language, op6_licences, op7_substrings, op8_bpe, op9_vectors, op10_main_text, op11_collocations, op12_source_divergence, op13_rank_bpe, pipeline)}

_COMPONENTS = """
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_minhash_near_dup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
often AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM often WHERE 100 * k >= 85 * (n + m - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT doc_id AS id FROM documents),{_COMPONENTS}
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM sets d JOIN components c ON d.doc_id = c.id""",
    "op4_tool_calls": """
WITH RECURSIVE calls AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 13 = 5 AND turn % 4 < 2 THEN turn + 2 ELSE turn - 2 END AS parent, (conv_id + turn) % 11 = 4 AS other_tool, (conv_id + turn) % 7 = 3 AS as_text, (conv_id + turn) % 7 = 5 AS no_json, conv_id % 9 = 4 AND turn % 4 = 0 AS twice FROM conversations WHERE role = 'user'),
depths(conv_id, turn, depth) AS (SELECT conv_id, turn, CAST(0 AS BIGINT) FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.parent)
  UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM depths d JOIN calls c ON c.conv_id = d.conv_id AND c.parent = d.turn),
places AS (SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn) - 1 AS position FROM depths),
linked AS (SELECT c.conv_id, concat('call-', c.turn) AS call_id, c.turn, CASE WHEN other_tool THEN 'lookup' ELSE 'reply' END AS name, d.depth, d.position,
  CASE WHEN d.depth IS NULL THEN 'cycle' WHEN twice THEN 'repeated' WHEN r.turn IS NULL THEN 'unanswered' WHEN c.conv_id % 8 = 6 THEN 'early' ELSE 'linked' END AS status,
  CASE WHEN other_tool THEN 'unknown tool' WHEN no_json THEN 'not an object' ELSE nullif(concat_ws('; ', CASE WHEN c.text IS NULL THEN 'prompt is missing' END, CASE WHEN as_text THEN 'turn is not integer' END), '') END AS errors,
  CASE WHEN no_json THEN 'null' ELSE concat('{', CASE WHEN c.text IS NOT NULL THEN concat('"prompt":', to_json(c.text), ',') ELSE '' END, '"turn":', CASE WHEN as_text THEN concat('"', c.turn, '"') ELSE CAST(c.turn AS VARCHAR) END, '}') END AS arguments, r.text AS content
  FROM calls c LEFT JOIN places d USING (conv_id, turn) LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant')
SELECT conv_id, call_id, turn, name, depth, position, status, errors,
  concat('{"arguments":', arguments, ',"call_id":"', call_id, '","conv_id":', conv_id, ',"depth":', coalesce(CAST(depth AS VARCHAR), 'null'), ',"errors":', coalesce(CAST(to_json(errors) AS VARCHAR), 'null'), ',"name":"', name, '","position":', coalesce(CAST(position AS VARCHAR), 'null'), ',"result":', coalesce(CAST(to_json(content) AS VARCHAR), 'null'), ',"status":"', status, '","turn":', turn, '}') AS canonical
FROM linked""",
    "op7_substrings": r"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM words)),
firsts AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (g) WHERE first_doc < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(ps, []), p)) AS k, w FROM words d LEFT JOIN lists l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(list_transform(k, lambda p: w[p]), ' '), '')) AS kept_sha256 FROM kept""",
    "op9_vectors": f"""
WITH RECURSIVE links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT vec_id AS id FROM embeddings),{_COMPONENTS}
SELECT vec_id, CAST((SELECT count(*) FROM both_ways WHERE a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN components ON vec_id = id""",
    "op11_collocations": rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS size)),
found AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 30),
split AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM found WHERE size > 1),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS cut FROM split)),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS score, cut FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = c.head JOIN found y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS part FROM split))),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY lang, phrase),
ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank FROM weakest w LEFT JOIN longer o ON w.lang = o.lang AND w.phrase = o.phrase WHERE o.a IS NULL OR CAST(100 AS HUGEINT) * o.a < CAST(80 AS HUGEINT) * w.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_source_divergence": rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(string_split_regex({_LOWER}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
terms AS (SELECT doc_id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
sets AS (SELECT DISTINCT lang, source FROM docs),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM sets LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v) AS p FROM totals t JOIN kept k USING (lang) JOIN kinds USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
common AS (SELECT k.lang, k.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q FROM kept k JOIN counts USING (lang, term) JOIN kinds USING (lang) JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) GROUP BY k.lang, k.term),
gaps AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM sets a JOIN sets b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN common USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
