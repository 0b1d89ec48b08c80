"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from ledgerscope.llm import chat_format, collocations, exact_dedup, line_dedup, mixing, quality, secret_scan, sharding
from ledgerscope.llm.bpe import op8_bpe
from ledgerscope.llm.chat_format import op11_chat_formatting
from ledgerscope.llm.collocations import op12_collocations
from ledgerscope.llm.exact_dedup import op9_exact_dedup
from ledgerscope.llm.html_extract import op1_html_extraction
from ledgerscope.llm.line_dedup import op6_line_dedup
from ledgerscope.llm.mixing import op10_source_mixing
from ledgerscope.llm.periodic_runs import op13_periodic_runs
from ledgerscope.llm.quality import op5_quality_rules
from ledgerscope.llm.secret_scan import op4_secret_scan
from ledgerscope.llm.sharding import op7_sharding
from ledgerscope.llm.simhash import op3_simhash_near_dedup
from ledgerscope.llm.url_filter import op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_url_filter, op3_simhash_near_dedup, op4_secret_scan, op5_quality_rules, op6_line_dedup,
        op7_sharding, op8_bpe, op9_exact_dedup, op10_source_mixing, op11_chat_formatting, op12_collocations,
        op13_periodic_runs,
    )
}
ORACLES = {
    "op4_secret_scan": secret_scan.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op11_chat_formatting": chat_format.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
