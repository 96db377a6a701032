"""The registered queries of the corpus operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from riskloom.llm.alignment import op12_alignment
from riskloom.llm.ann import op7_ann
from riskloom.llm.chat_format import OP5_SQL, op5_chat_format
from riskloom.llm.divergence import OP11_SQL, op11_divergence
from riskloom.llm.embed_dedup import op2_embedding_dedup
from riskloom.llm.language import op13_language
from riskloom.llm.line_dedup import OP1_SQL, op1_line_dedup
from riskloom.llm.mixing import OP10_SQL, op10_mixing
from riskloom.llm.packing import op4_packing
from riskloom.llm.quality import op8_quality
from riskloom.llm.simhash import op6_simhash
from riskloom.llm.suffix_dedup import op3_suffix_dedup
from riskloom.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_embedding_dedup": op2_embedding_dedup, "op3_suffix_dedup": op3_suffix_dedup, "op4_packing": op4_packing, "op5_chat_format": op5_chat_format,
           "op6_simhash": op6_simhash, "op7_ann": op7_ann,
           "op8_quality": op8_quality, "op9_url_filter": op9_url_filter, "op10_mixing": op10_mixing,
           "op11_divergence": op11_divergence, "op12_alignment": op12_alignment,
           "op13_language": op13_language}
ORACLES = {"op1_line_dedup": OP1_SQL, "op5_chat_format": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_mixing": OP10_SQL,
           "op11_divergence": OP11_SQL}
