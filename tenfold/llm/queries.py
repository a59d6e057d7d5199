"""The thin queries of the corpus operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, language_id, licenses, line_dedup, merkle, minhash, packing, quality, secret_scan, suffix_dedup, token_files, warc
from .common import ship


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), (F.octet_length("data") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.expr("transform(places, p -> p.label)")
    best = F.coalesce(F.array_max(F.expr("transform(blocks, b -> b.containment)")), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.expr("transform(places, p -> p.word)")).alias("first_word"), F.array_max(F.expr("transform(places, p -> p.word)")).alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, F.expr("transform(blocks, b -> b.label)"))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=decontaminate.NEAR)
    return found.select("doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    whole = F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), "error")).cast("long"))  # a record lost must not pass as a row of nulls
    return found.select("page_id", whole.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.clean(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_files.with_crc32(token_files.with_starts(token_files.read(spark, path)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), received=F.when(spoiled, merkle.leaf(merkle.tampered())))
    folded = found.withColumn("folded_root", merkle.folded(F.coalesce("received", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    placed, planned = conversations.repair(conversations.damaged(rows))
    found = planned.drop("pieces").join(conversations.digests(placed, planned), "g", "left")
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", conversations.group_of().alias("g")).join(found, "g", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.new_ledger(spark))
    shown = lambda x: F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(shown(of(*[r.kind for r in secret_scan.BASE])).cast("binary"), 256).alias("base_sha256"), shown(F.col("findings")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_license_scan, op4_packing, op5_decontamination, op6_language_id, op7_warc, op8_line_dedup, op9_minhash, op10_token_files, op11_merkle_manifest, op12_conversation_repair, op13_secret_scan)}
