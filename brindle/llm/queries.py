"""The corpus queries by name, and SQL for those that SQL expresses."""

from brindle.llm.chat import OP1_SQL, op1_chat_format
from brindle.llm.digest import op4_canonical_digest
from brindle.llm.extract import op10_html_extraction
from brindle.llm.lines import OP7_SQL, op7_line_dedup
from brindle.llm.mixing import op5_pfair_mixing
from brindle.llm.negatives import OP13_SQL, op13_hard_negatives
from brindle.llm.neighbours import op11_quality_neighbours
from brindle.llm.packing import op2_best_fit_packing
from brindle.llm.private import op9_disclosure
from brindle.llm.rules import op8_quality_rules
from brindle.llm.search import OP12_SQL, op12_ranked_search
from brindle.llm.shards import OP3_SQL, op3_byte_shards
from brindle.llm.simhash import op6_simhash

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_shards": op3_byte_shards,
    "op4_canonical_digest": op4_canonical_digest,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_disclosure": op9_disclosure,
    "op10_html_extraction": op10_html_extraction,
    "op11_quality_neighbours": op11_quality_neighbours,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op3_byte_shards": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
