"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from cellgrid.llm.bpe_codec import op10_bpe_codec
from cellgrid.llm.html_extract import op4_html_extraction
from cellgrid.llm.linededup import OP1_SQL, op1_line_dedup
from cellgrid.llm.media import op2_media_sniffing
from cellgrid.llm.minhash import op5_minhash_neardup
from cellgrid.llm.mixing import OP9_SQL, op9_mix_sources
from cellgrid.llm.prefix_tokens import op3_prefix_token_counts
from cellgrid.llm.quality import op8_quality_classifier
from cellgrid.llm.rules import op6_quality_rules
from cellgrid.llm.secret_scan import op7_secret_scan

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_media_sniffing": op2_media_sniffing,
    "op3_prefix_token_counts": op3_prefix_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mix_sources": op9_mix_sources,
    "op10_bpe_codec": op10_bpe_codec,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op9_mix_sources": OP9_SQL,
}
