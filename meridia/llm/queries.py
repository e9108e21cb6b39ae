"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from meridia.llm import (
    byte_bpe, chat, exact_dedup, fill_middle, language, lexical, line_dedup, mixing, near_dedup, passage_dedup, token_files, topk, toxicity,
)
from meridia.llm.common import table
from meridia.plans.catalog import Catalog
from meridia.session import durable, scratch_path

catalog = Catalog()

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@catalog.add("op1_byte_bpe")
def op1(spark, sf_dir):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@catalog.add("op2_passage_dedup")
def op2(spark, sf_dir):
    left = passage_dedup.dedup_passages(table(spark, sf_dir, "documents"), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@catalog.add("op3_mixing", """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
slots AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot, 2.0::DOUBLE * source_size AS most FROM totals),
leveled AS (SELECT *, [3.0, 1.0, 2.0][slot + 1]::DOUBLE AS w, most / w AS full_at FROM slots),
ahead AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS demand,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM leveled WINDOW before AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, slot, demand,
    least(most, coalesce(first_value(CASE WHEN level <= full_at THEN level END IGNORE NULLS) OVER (ORDER BY full_at, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * w, most)) AS target FROM ahead),
placed AS (SELECT doc_id, size, source_size, slot, demand, target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ran
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
timed AS (SELECT *, least(ran / target, 1.0::DOUBLE) AS u FROM placed)
SELECT doc_id, size, source_size, target,
  size * ((ran + size / 2.0::DOUBLE < target)::BIGINT + (source_size + ran + size / 2.0::DOUBLE < target)::BIGINT) AS taken,
  CASE WHEN ran + size / 2.0::DOUBLE < target THEN floor(demand * CASE slot
    WHEN 0 THEN 2.0::DOUBLE * u / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * u))
    WHEN 1 THEN u
    ELSE CASE WHEN u * 0.875::DOUBLE < 0.25::DOUBLE THEN 2.0::DOUBLE * (u * 0.875::DOUBLE) / 1.0::DOUBLE
      ELSE 0.5::DOUBLE + 2.0::DOUBLE * (u * 0.875::DOUBLE - 0.25::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 6.0::DOUBLE * (u * 0.875::DOUBLE - 0.25::DOUBLE))) END
    END)::BIGINT END AS first_position
FROM timed""")
def op3(spark, sf_dir):
    mixed = mixing.plan(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"),
        F.floor(F.get("positions", F.lit(0))).cast("bigint").alias("first_position"))


@catalog.add("op4_near_dedup")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, shingle=4, threshold=0.8).drop("row")


@catalog.add("op5_token_files")
def op5(spark, sf_dir):
    folder = scratch_path(spark, "ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added=True)
    return token_files.read_ids(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@catalog.add("op6_line_dedup", f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, pos, line, translate(trim(line, {BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base)),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS dropped FROM lines l LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op6(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@catalog.add("op7_language")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language.fit(docs.where(~held), bound=3000)
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@catalog.add("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.scored(docs, toxicity.fit_labels(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", "severity.severity", "severity.grade", "severity.p_toxic", "severity.toxic")


@catalog.add("op9_topk", """
WITH vectors AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5""")
def op9(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


@catalog.add("op10_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op10(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


MARKS_SQL = r"(<|\[)(INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|<ROLE>>|<TEXT>>|</TEXT>>)"


@catalog.add("op11_chat", rf"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(n)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
spelled AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '{MARKS_SQL}', '\1\\\2', 'g') AS body,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 26 + length(regexp_replace(replace(role, '\', '\\'), '{MARKS_SQL}', '\1\\\2', 'g')) END AS marks FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + marks)::BIGINT AS formatted_chars
FROM spelled GROUP BY conv_id""")
def op11(spark, sf_dir):
    fixed = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    read = chat.read_back(durable(chat.format_paths(chat.as_messages(turns)), "chats"))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


@catalog.add("op12_lexical", r"""
WITH found AS (SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
docs AS (SELECT d, doc_id, len(terms) AS n, terms FROM found WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM docs),
counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term),
asked AS (SELECT item_id, i, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS i,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, i, term),
scored AS (SELECT item_id, i, d, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // length))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN docs USING (d), corpus GROUP BY item_id, i, d, doc_id),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""")
def op12(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10, b=75)


@catalog.add("op13_fill_middle", """
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM base),
cut AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM drawn),
parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""")
def op13(spark, sf_dir):
    folder = scratch_path(spark, "frames")
    fill_middle.store(table(spark, sf_dir, "documents"), folder)
    return fill_middle.digests(fill_middle.fill_middle(fill_middle.load(spark, folder), seed=1, rate=90, spm=20))


catalog.add("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
