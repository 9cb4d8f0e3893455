"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, exact_dedup, language_id, lexical_search, license_scan, lm_scoring, mixing, near_dedup, token_files, toxicity, vector_search
from .common import fold, held_out, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_domain(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(docs, mixing.WEIGHTS, mixing.SHARE, max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED)
    return mixed.select(
        "doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_taken").alias("taken"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    # a VARIANT object leaves null fields in, so that all rows have one layout
    records = rows.unionByName(extra).select(
        "conv_id", "turn",
        F.expr("to_variant_object(named_struct('role', coalesce(role, ''), 'text', coalesce(text, ''), 'turn', coalesce(turn, 0)))").alias("record"),
    )
    convs = chat.conversations_from_rows(chat.canonical_turns(records))
    out = chat.format_conversations(convs).select("conv_id", "formatted", "loss")
    turns = chat.read_back(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn("loss_text", chat.masked_text(F.col("formatted"), F.col("loss")))
    all_text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op4_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    vecs = vecs.where(vector_search.usable(F.col("embedding"))).select("vec_id", vector_search.floor_scaled(F.col("embedding")).alias("vec"))
    found = vector_search.top_k(vecs.where("vec_id % 50 = 0"), vecs, 5)
    return found.select("query_id", "rank", F.col("item_id").alias("vec_id"), "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), token_files.tokenizer_encoder(_vocabulary("byte_bpe_50k.json"), added=True), path, vocab_size=50257)
    return token_files.read_tokens(spark, path)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    times = F.aggregate("rules", F.lit(0).cast("long"), lambda a, r: a + r["times"])
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), times.alias("n_matches"), F.array_join("licences", ",").alias("licences"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))), fold=fold(F.col("_id")))


TOXIC_FROM = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), added=True)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2
    found = lm_scoring.score(table(spark, sf_dir, "documents"), ~held)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_source_mix, op2_chat_format, op3_language_id, op4_vector_topk, op5_near_dedup, op6_exact_dedup, op7_token_files, op8_license_scan, op9_toxicity, op10_bpe, op11_lm_scoring, op12_collocations, op13_lexical_search)
}
ORACLES = {
    "op1_source_mix": mixing.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op4_vector_topk": vector_search.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
