"""Registered queries of the text operators: thin, whole tables, production parameters."""

from __future__ import annotations

from souk.llm import bpe, divergence, fingerprints, lm, mixing, pii, quality, repair, rules, simhash, toxicity, warc, wordpiece
from souk.sources.tables import read


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents", *columns)


QUERIES = {
    "op1_bpe_transducer": lambda s, d: bpe.encode(_docs(s, d, "doc_id", "text"), vocabulary("word_bpe_49k.json"), with_ids=False),
    "op2_elias_fano_lm": lambda s, d: lm.score(_docs(s, d, "doc_id", "text")),
    "op3_order_minhash": lambda s, d: fingerprints.fingerprints(_docs(s, d, "doc_id", "text")),
    "op4_longest_match_counts": lambda s, d: wordpiece.count_tokens(
        _docs(s, d, "doc_id", "text"), wordpiece.read_pieces(vocabulary("byte_bpe_50k.json"))),
    "op5_toxicity": lambda s, d: toxicity.toxicity(_docs(s, d, "doc_id", "text"), read(s, d, "labels", "doc_id", "toxic")),
    "op6_weak_pii": lambda s, d: pii.personal_data(_docs(s, d, "doc_id", "text")),
    "op7_quality_trees": lambda s, d: quality.quality(_docs(s, d, "doc_id", "text"), read(s, d, "labels", "doc_id", "quality")),
    "op8_simhash_golay": lambda s, d: simhash.near_duplicates(_docs(s, d, "doc_id", "text")),
    "op9_mix_sources": lambda s, d: mixing.mix_report(_docs(s, d, "doc_id", "text", "source")),
    "op10_rule_cascade": lambda s, d: rules.rules_report(_docs(s, d, "doc_id", "text")),
    "op11_source_divergence": lambda s, d: divergence.audit(_docs(s, d, "text", "lang", "source")),
    "op12_warc_round_trip": lambda s, d: warc.round_trip(read(s, d, "pages", "page_id", "url", "html")),
    "op13_conversation_repair": lambda s, d: repair.damaged_and_repaired(read(s, d, "conversations", "conv_id", "turn", "role", "text")),
}
SQL = {"op9_mix_sources": mixing.MIX_SQL, "op10_rule_cascade": rules.RULES_SQL,
       "op11_source_divergence": divergence.AUDIT_SQL, "op12_warc_round_trip": warc.WARC_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
