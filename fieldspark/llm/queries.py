"""Queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from fieldspark.llm.op1_warc import OP1_SQL, op1_warc
from fieldspark.llm.op2_exact import OP2_SQL, op2_exact_dedup
from fieldspark.llm.op3_pii import op3_pii
from fieldspark.llm.op4_licenses import op4_licenses
from fieldspark.llm.op5_minhash import op5_minhash_dedup
from fieldspark.llm.op6_quality import op6_quality
from fieldspark.llm.op7_html import op7_html
from fieldspark.llm.op8_toxicity import op8_toxicity
from fieldspark.llm.op9_pieces import op9_sentencepiece
from fieldspark.llm.op10_decontaminate import op10_decontaminate
from fieldspark.llm.op11_search import OP11_SQL, op11_search
from fieldspark.llm.op12_variants import OP12_SQL, op12_variants
from fieldspark.llm.op13_rules import OP13_SQL, op13_rules

QUERIES = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_licenses": op4_licenses,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontaminate": op10_decontaminate,
    "op11_search": op11_search,
    "op12_variants": op12_variants,
    "op13_rules": op13_rules,
}

ORACLE = {"op1_warc": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op11_search": OP11_SQL, "op12_variants": OP12_SQL, "op13_rules": OP13_SQL}
