"""Queries over the test tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, remove, table
from . import bpe, chat, decontaminate, html, langid, manifest, media, neardup, negatives, quality, samples, secrets, store, suffix
from .oracles import OP11_SQL, OP12_SQL, OP13_SQL
from .texts import bounded_batches

try:
    from public_tokenizers import path as tokenizer_path
except ModuleNotFoundError:  # then the folder is a parameter
    def tokenizer_path(name: str) -> str:
        return f"/opt/tokenizers/{name}"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = samples.fold(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.filter(~held_out))
    p = docs.select("doc_id", held_out.alias("held_out"), langid.prediction(F.col("text"), model).alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = store.write_store(store.encode_documents(docs, tokenizer_path("byte_bpe_50k.json")))
    back = store.read_store(written).select("doc_id", "row", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return back.join(store.starts(written), "row").select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(samples.fold(F.col("doc_id"), 3) != 1))
    scored = docs.select("doc_id", (samples.fold(F.col("doc_id"), 3) == 1).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
grams AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM both_ UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ e ON r.other = e.a),
low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.low, s.doc_id) AS component_id, coalesce(l.low, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN low l ON s.doc_id = l.doc_id
"""


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "share", "slots", "changed", "kind")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"), 400)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    written = materialize(chat.format_chats(chat.messages_by_turn(rows.unionByName(more))), "chats")
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_chats(written).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?(?:SYS|ROLE|TURN)>>'))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 26 + length(role) END AS chars
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.write_images(table(spark, sf_dir, "documents"))
    tiles = media.write_tiles(media.read_features(stored))
    return tiles.withColumns({"tile_hash": media.tile_hash(F.col("tile")), "tile_sha256": F.sha2("tile", 256)}).drop("tile")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", secrets.spans(F.col("text")).alias("s"))

    def of(*kinds: str) -> Column:
        return F.filter("s", lambda x: x["kind"].isin(*kinds))

    base = ("assign", "access", "hex")
    counts = (F.size(of(k)).cast("long").alias(f"n_{k}") for k in base)
    return rows.select("doc_id", *counts, F.sha2(secrets.told(of(*base)), 256).alias("base_sha256"), secrets.told(F.col("s")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"))
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    *rest, text = map(F.col, docs.columns)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.leaf_digest(*rest, manifest.lower_ascii(text)))
    leaves = materialize(docs.select("doc_id", "lang", manifest.leaf_digest(*rest, text).alias("leaf"), changed.alias("changed")), "digests")
    m = manifest.build(leaves)
    now = F.coalesce("changed", "leaf")
    found = manifest.proofs(m).select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), manifest.folded(F.col("path"), now).alias("folded_root"))
    out = materialize(found.withColumn("verified", F.col("folded_root") == F.col("root")), "verified")
    m.remove()
    remove(leaves)
    return out


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_store": op2_token_store,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_html_main_text": op6_html_main_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_media_columns": op10_media_columns,
    "op11_secret_scan": op11_secret_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {
    "op5_near_duplicates": OP5_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_secret_scan": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
