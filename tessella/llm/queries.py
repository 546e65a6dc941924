"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from tessella.llm import crosstok, decontam, html, langid, mixing, quality, secrets, sharding, simhash, spelling, tokenbin, urlfilter, warc


def queries() -> dict:
    return {
        "op1_decontaminate": decontam.query,
        "op2_language_id": langid.query,
        "op3_mix_sources": mixing.query,
        "op4_html_main_text": html.query,
        "op5_token_binary": tokenbin.query,
        "op6_simhash_dedup": simhash.query,
        "op7_balanced_shards": sharding.query,
        "op8_url_filter": urlfilter.query,
        "op9_quality_rules": quality.query,
        "op10_warc_dictionary": warc.query,
        "op11_secret_novelty": secrets.query,
        "op12_spelling_variants": spelling.query,
        "op13_token_groups": crosstok.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op8_url_filter": urlfilter.ORACLE_SQL, "op10_warc_dictionary": warc.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
