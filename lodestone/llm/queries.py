"""The subpackage's queries and SQL, by name."""

from __future__ import annotations

from lodestone.llm import bpe, decontaminate, licenses, quality, secrets, sharding, simhash, substring, tokens, urls

QUERIES = {
    f.__name__: f
    for f in (
        tokens.op1_token_counts, licenses.op2_license_scan, simhash.op3_simhash_dedup, substring.op4_substring_dedup, secrets.op5_secret_scan,
        bpe.op6_byte_bpe, urls.op7_url_filter, decontaminate.op8_decontaminate, quality.op9_quality_rules, sharding.op10_shard,
    )
}

ORACLE_SQL = {
    "op4_substring_dedup": substring.OP4_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op7_url_filter": urls.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_shard": sharding.OP10_SQL,
}
