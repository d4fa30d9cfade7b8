"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, prefix_trie, secrets, warc
from .decontaminate import op4_decontamination
from .filter_audit import op13_filter_audit
from .license_scan import op11_licenses
from .packing import op6_packing
from .pii import op7_pii
from .prefix_trie import op12_prefix_trie
from .quality_knn import op5_quality
from .quality_rules import op9_quality_rules
from .secrets import op1_secrets
from .simhash import op8_simhash
from .substring_dedup import op2_substring_dedup
from .toxicity import op10_toxicity
from .warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_licenses": op11_licenses,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secrets": secrets.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
