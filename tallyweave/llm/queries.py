"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tallyweave.llm.bpe_codec import op6_bpe_codec
from tallyweave.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tallyweave.llm.html_text import op13_html_text
from tallyweave.llm.language_id import op1_language_id
from tallyweave.llm.line_dedup import op5_line_dedup
from tallyweave.llm.mixing import op4_source_mix
from tallyweave.llm.near_dedup import op2_near_dedup
from tallyweave.llm.nearest_neighbours import op9_nearest_neighbours
from tallyweave.llm.substring_dedup import op10_substring_dedup
from tallyweave.llm.token_count import op8_token_counts
from tallyweave.llm.toxicity import op7_toxicity
from tallyweave.llm.vector_codes import OP12_SQL, op12_vector_codes
from tallyweave.llm.whitening import op11_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_html_text": op13_html_text,
}

ORACLES: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op12_vector_codes": OP12_SQL}
