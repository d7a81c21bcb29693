"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from foliomill.llm import jaccard_join, license_scan, mixing, packing, personal_data, quality_rules, sharding, url_rules, vector_search, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_vector_search": vector_search.op6_vector_search,
    "op7_packing": packing.op7_packing,
    "op8_personal_data": personal_data.op8_personal_data,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_url_rules": url_rules.op10_url_rules,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_vector_search": vector_search.OP6_SQL,
    "op10_url_rules": url_rules.OP10_SQL,
}
