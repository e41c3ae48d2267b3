"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .fingerprints import op2_fingerprints
from .langid import op6_language_id
from .lines import ORACLE_SQL as OP7_SQL
from .lines import op7_line_dedup
from .minhash import ORACLE_SQL as OP1_SQL
from .minhash import op1_minhash_dedup
from .packing import op9_packing
from .phrases import ORACLE_SQL as OP13_SQL
from .phrases import op13_phrases
from .prefixes import ORACLE_SQL as OP11_SQL
from .prefixes import op11_prefix_trie
from .quality import op4_quality_rules
from .simhash import op12_simhash_dedup
from .substrings import ORACLE_SQL as OP8_SQL
from .substrings import op8_substring_dedup
from .toxicity import op10_toxicity
from .wordpiece import op5_token_counts


def queries() -> dict:
    found = (op1_minhash_dedup, op2_fingerprints, op3_bpe, op4_quality_rules, op5_token_counts, op6_language_id, op7_line_dedup, op8_substring_dedup, op9_packing, op10_toxicity, op11_prefix_trie, op12_simhash_dedup, op13_phrases)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op7_line_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_phrases": OP13_SQL}
