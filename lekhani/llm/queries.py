"""The queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from lekhani.llm import lines, sql
from lekhani.llm.bpe import op9_bpe
from lekhani.llm.decontaminate import op2_decontaminate
from lekhani.llm.embeddings import op3_embeddings
from lekhani.llm.html import op8_html
from lekhani.llm.language import op1_language
from lekhani.llm.licenses import op10_licenses
from lekhani.llm.lines import op7_lines
from lekhani.llm.lm import op5_lm
from lekhani.llm.minhash import op4_minhash
from lekhani.llm.quality import op6_quality

QUERIES = {f.__name__: f for f in (op1_language, op2_decontaminate, op3_embeddings, op4_minhash, op5_lm, op6_quality, op7_lines, op8_html, op9_bpe, op10_licenses)}
ORACLES: dict[str, str] = {"op3_embeddings": sql.near_vectors(), "op4_minhash": sql.near_documents(3, 85), "op7_lines": sql.near_lines(lines.SHINGLE, lines.PERCENT)}
