"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from barloom.llm import bpe, conversations, embeddings, mixing, pages, pii, quality, repeats, simhash, sketch, token_counts, toxicity, vector_codes
from barloom.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {
    "op1_embedding_near_dedup": lambda spark, sf_dir: embeddings.query(table(spark, sf_dir, "embeddings")),
    "op2_source_mixing": lambda spark, sf_dir: mixing.query(table(spark, sf_dir, "documents")),
    "op3_html_extraction": lambda spark, sf_dir: pages.query(table(spark, sf_dir, "pages")),
    "op4_suffix_array_dedup": lambda spark, sf_dir: repeats.query(table(spark, sf_dir, "documents")),
    "op5_document_fingerprints": lambda spark, sf_dir: sketch.query(table(spark, sf_dir, "documents")),
    "op6_pii_pseudonyms": lambda spark, sf_dir: pii.query(table(spark, sf_dir, "documents")),
    "op7_quality_classifier": lambda spark, sf_dir: quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_simhash_near_dedup": lambda spark, sf_dir: simhash.query(table(spark, sf_dir, "documents")),
    "op9_byte_bpe": lambda spark, sf_dir: bpe.query(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN),
    "op10_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_conversation_repair": lambda spark, sf_dir: conversations.query(table(spark, sf_dir, "conversations")),
    "op12_vector_codes": lambda spark, sf_dir: vector_codes.query(table(spark, sf_dir, "embeddings")),
    "op13_token_counts": lambda spark, sf_dir: token_counts.query(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN),
}

ORACLES = {
    "op1_embedding_near_dedup": embeddings.ORACLE,
    "op2_source_mixing": mixing.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
