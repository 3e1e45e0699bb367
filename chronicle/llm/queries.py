"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from chronicle.llm.decontaminate import OP10_SQL, op10_decontaminate
from chronicle.llm.fingerprints import op5_fingerprints
from chronicle.llm.html_text import op2_html_text
from chronicle.llm.language_id import op1_language_id
from chronicle.llm.lexical_search import OP12_SQL, op12_lexical_search
from chronicle.llm.line_dedup import OP6_SQL, op6_line_dedup
from chronicle.llm.piece_codec import op3_sentencepiece
from chronicle.llm.resampling import OP13_SQL, op13_resampling
from chronicle.llm.sharding import op7_sharding
from chronicle.llm.simhash_dedup import op8_simhash
from chronicle.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from chronicle.llm.suffix_dedup import op4_suffix_dedup
from chronicle.llm.token_ids import op11_token_ids

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_text": op2_html_text,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_ids": op11_token_ids,
    "op12_lexical_search": op12_lexical_search,
    "op13_resampling": op13_resampling,
}
SQL = {"op6_line_dedup": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_resampling": OP13_SQL}
