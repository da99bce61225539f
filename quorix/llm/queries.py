"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from quorix.session import ship

from . import chunks, decontaminate, jaccard, katz, licenses, mixing, oracles, rules, suffixes, tokens, warc


def _shipped(query):
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


QUERIES = {name: _shipped(query) for name, query in {
    "op1_chunk_dedup": chunks.query,
    "op2_katz_scores": katz.query,
    "op3_decontaminate": decontaminate.query,
    "op4_suffix_dedup": suffixes.query,
    "op5_quality_rules": rules.query,
    "op6_mix_sources": mixing.query,
    "op7_license_scan": licenses.query,
    "op8_token_counts": tokens.query,
    "op9_warc_revisits": warc.query,
    "op10_jaccard_join": jaccard.query,
}.items()}

ORACLES = {
    "op4_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op5_quality_rules": rules.SQL,
    "op6_mix_sources": mixing.SQL,
    "op7_license_scan": oracles.LICENSE_SCAN,
    "op9_warc_revisits": warc.SQL,
    "op10_jaccard_join": oracles.JACCARD_JOIN,
}
