"""The queries of this subpackage: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm import alignment, ann, bpe, chat, common, lm, media, minhash, mixing, negatives, pii, suffixes, toxicity, warc


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), want=("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"))
    return found.drop("text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.conversations(common.table(spark, sf_dir, "conversations"))
    made = chat.format_preferences(chat.pairs_by_opening(chats).union(chat.pairs_by_answer(chats)))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return made.select("kind", "chosen_id", "rejected_id", "n_common", "prompt", "chosen_text", spans("chosen_spans").alias("chosen_mask"), "rejected_text", spans("rejected_spans").alias("rejected_mask"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    examined = media.examine(media.store(docs))
    n_bytes = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    pages = docs.select("doc_id", n_bytes.alias("n_bytes"), media.as_page(F.col("text"), F.col("source")).alias("html"))
    items = media.sequences(pages, keep=("doc_id", "n_bytes"))
    items = items.withColumn("n_texts", F.size(F.filter("items", lambda x: x["kind"] == "text")).cast("long"))
    refs = media.references(items, ("doc_id", "n_bytes", "n_texts"))
    found = media.resolve(refs, examined)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_texts")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.plan_records(common.table(spark, sf_dir, "pages"))
    archives = common.stash(warc.write_archives(records), "warc-whole", codec="uncompressed")
    members = common.stash(warc.normalise(archives), "warc-members", codec="uncompressed")
    return warc.read_records(members, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), width=2)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(common.table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.plan(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.round(F.get("positions", F.lit(0)), 9).alias("first_position")
    return made.select("doc_id", "size", "source_size", "target", "taken", "source", "n_copies", first, F.array_join("ranks", ",").alias("ranks"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(common.table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_chat": op3_chat,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_minhash": op7_minhash,
    "op8_lm": op8_lm,
    "op9_mixing": op9_mixing,
    "op10_ann": op10_ann,
    "op11_suffixes": op11_suffixes,
    "op12_alignment": op12_alignment,
    "op13_negatives": op13_negatives,
}

_CHAT_SQL = """
WITH turn_rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
opening AS (SELECT conv_id, role, text, min(conv_id) OVER (PARTITION BY role, text) AS least FROM turn_rows WHERE i = 1),
answers AS (
  SELECT conv_id, max(i) AS last_i, min(i) AS first_i FROM turn_rows WHERE role = 'assistant'
  GROUP BY conv_id HAVING count(*) > 1),
pairs AS (
  SELECT 'opening' AS kind, least AS chosen_id, conv_id AS rejected_id FROM opening WHERE least <> conv_id
  UNION ALL SELECT 'answer', conv_id, conv_id FROM answers),
sides AS (
  SELECT p.*, 'c' AS side, t.i, t.role, t.text FROM pairs p JOIN turn_rows t ON t.conv_id = p.chosen_id
    LEFT JOIN answers a ON a.conv_id = p.chosen_id WHERE p.kind = 'opening' OR t.i <= a.last_i
  UNION ALL
  SELECT p.*, 'r', t.i, t.role, t.text FROM pairs p JOIN turn_rows t ON t.conv_id = p.rejected_id WHERE p.kind = 'opening'
  UNION ALL
  SELECT p.*, 'r', t.i, t.role, CASE WHEN t.i = a.last_i THEN f.text ELSE t.text END
  FROM pairs p JOIN answers a ON a.conv_id = p.chosen_id JOIN turn_rows t ON t.conv_id = p.chosen_id AND t.i <= a.last_i
    JOIN turn_rows f ON f.conv_id = p.chosen_id AND f.i = a.first_i WHERE p.kind = 'answer'),
first_difference AS (
  SELECT kind, chosen_id, rejected_id, coalesce(min(CASE WHEN NOT same THEN i END), max(i) + 1) - 1 AS n_common FROM (
    SELECT kind, chosen_id, rejected_id, i,
      count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
    FROM sides GROUP BY kind, chosen_id, rejected_id, i)
  GROUP BY kind, chosen_id, rejected_id),
rendered AS (
  SELECT s.*, d.n_common, '<|' || regexp_replace(s.role, '[^A-Za-z0-9_-]', '_', 'g') || '|>' || chr(10) AS head,
    replace(s.text, '<|', '<||') || '<|end|>' || chr(10) AS body
  FROM sides s JOIN first_difference d USING (kind, chosen_id, rejected_id)),
placed AS (
  SELECT *, sum(CASE WHEN i > n_common THEN length(head) + length(body) ELSE 0 END)
    OVER (PARTITION BY kind, chosen_id, rejected_id, side ORDER BY i) AS ends FROM rendered)
SELECT kind, chosen_id, rejected_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 'c' AND i <= n_common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 'c' AND i > n_common), '') AS chosen_text,
  coalesce(string_agg((ends - length(body))::BIGINT || ':' || ends::BIGINT, ',' ORDER BY i) FILTER (side = 'c' AND i > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 'r' AND i > n_common), '') AS rejected_text,
  coalesce(string_agg((ends - length(body))::BIGINT || ':' || ends::BIGINT, ',' ORDER BY i) FILTER (side = 'r' AND i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY kind, chosen_id, rejected_id
"""

_MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(source, ''), '|', md5(coalesce(text, '')))) AS draw, row_number() OVER () AS r
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM per_source),
levels AS (  -- at level x each source takes min(cap, weight * x); caps are filled one after another
  SELECT a.cap / a.weight AS x, sum(least(b.cap, b.weight * (a.cap / a.weight))) AS amount FROM weighed a CROSS JOIN weighed b GROUP BY a.source, a.cap, a.weight),
level AS (SELECT coalesce(max(x), 0) AS x FROM levels, (SELECT max(budget) AS budget FROM weighed) WHERE amount <= budget),
targets AS (
  SELECT w.*, CASE WHEN cap / weight <= x THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (cap / weight <= x) OVER (), 0))
    / sum(weight) FILTER (cap / weight > x) OVER () END AS target FROM weighed w, level),
numbered AS (
  SELECT s.*, t.place, t.source_size, t.target, sum(s.size) OVER (PARTITION BY t.place ORDER BY s.draw, s.r) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, before + j * source_size + size / 2.0::DOUBLE AS middle FROM numbered, (VALUES (0), (1)) AS passes(j) WHERE j = 0 OR source_size > 0),
due AS (
  SELECT r, draw, j, CASE place % 3 WHEN 0 THEN (1.5::DOUBLE - sqrt(greatest(0, 2.25::DOUBLE - 2 * y))) WHEN 1 THEN y ELSE (sqrt(0.25::DOUBLE + 2 * y) - 0.5::DOUBLE) END AS t
  FROM (SELECT *, CASE WHEN target > 0 THEN middle / target ELSE 0 END AS y FROM copies) WHERE middle <= target),
ranked AS (SELECT *, row_number() OVER (ORDER BY t, draw, j, r) - 1 AS k FROM due),
found AS (
  SELECT r, count(*) AS n, round(min(t), 9) AS first_position, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS ranks FROM ranked GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken, source, CAST(coalesce(n, 0) AS BIGINT) AS n_copies, first_position, coalesce(ranks, '') AS ranks
FROM numbered LEFT JOIN found USING (r)
"""

_NEGATIVES_SQL = """
WITH rows_ AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor, a.label, b.vec_id AS other, b.label AS other_label, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor, other, score FROM scored WHERE label = other_label QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT p.anchor AS anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND n.label <> n.other_label AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op3_chat": _CHAT_SQL, "op9_mixing": _MIXING_SQL, "op13_negatives": _NEGATIVES_SQL}
