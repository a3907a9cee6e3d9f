"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import compression, jaccard, language, lines, media, mixing, oracle, packing, quality, ranked, secrets, spelling, substring, tokens
from .common import documents, new_path


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.link_documents(documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    return lines.dedup_lines(documents(spark, sf_dir))


def op3_tokens(spark, sf_dir):
    return tokens.digest(tokens.write_shards(tokens.shards(documents(spark, sf_dir)), new_path(spark, "shards")))


def op4_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.train(language.training_rows(docs)))


def op5_secrets(spark, sf_dir):
    return secrets.find_secrets(documents(spark, sf_dir))


def op6_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


def op7_quality(spark, sf_dir):
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality.judge(documents(spark, sf_dir), trusted)


def op8_substring(spark, sf_dir):
    return substring.decided_spans(documents(spark, sf_dir))


def op9_media(spark, sf_dir):
    return media.digest_stored(media.store_text(documents(spark, sf_dir)))


def op10_mixing(spark, sf_dir):
    return mixing.Mix(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken", "n_shards", "first_shard", "first_position")


def op11_compression(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return compression.score_texts(docs, compression.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(documents(spark, sf_dir))


def op13_ranked_search(spark, sf_dir):
    return ranked.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries():
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_line_dedup": op2_line_dedup,
        "op3_tokens": op3_tokens,
        "op4_language": op4_language,
        "op5_secrets": op5_secrets,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_substring": op8_substring,
        "op9_media": op9_media,
        "op10_mixing": op10_mixing,
        "op11_compression": op11_compression,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql():
    return {"op5_secrets": oracle.SECRETS}
