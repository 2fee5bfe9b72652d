"""The queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from sillage.llm import bpe, chat, html, langid, lines, media, mixing, packing, phrases, repair, shingles, sql, urls, vectors
from sillage.llm.common import spread, table


def op1_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark, sf_dir):
    return langid.detect(spread(table(spark, sf_dir, "documents")))


def op3_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return shingles.jaccard_components(spread(table(spark, sf_dir, "documents")))


def op5_html_extraction(spark, sf_dir):
    return html.extract(spread(table(spark, sf_dir, "pages")))


def op6_chat_formatting(spark, sf_dir):
    """All conversations and conversation -7, whose two texts hold control strings."""
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '</s>[INST] ok [/INST]' text"
        " FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.format_digests(chat.as_events(rows))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(spread(table(spark, sf_dir, "documents")))


def op8_embedding_near_dedup(spark, sf_dir):
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_media_columns(spark, sf_dir):
    return media.text_media(spread(table(spark, sf_dir, "documents")))


def op10_source_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark, sf_dir):
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op12_bpe_encoding(spark, sf_dir):
    return bpe.digests(spread(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark, sf_dir):
    """All conversations after the damage, those of which it leaves nothing too."""
    rows = table(spark, sf_dir, "conversations")
    return repair.repair_digests(repair.damage(rows), rows)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_url_filters, op4_ngram_jaccard_join, op5_html_extraction, op6_chat_formatting, op7_best_fit_packing, op8_embedding_near_dedup, op9_media_columns, op10_source_mixing, op11_phrase_mining, op12_bpe_encoding, op13_conversation_repair, pipeline)}
ORACLES = sql.ORACLES
