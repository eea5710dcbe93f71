"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

import corpus_pipeline
from skyloom.llm import collocations, mixing
from skyloom.llm.bpe import op3_bpe
from skyloom.llm.collocations import op12_collocations
from skyloom.llm.fingerprints import op1_fingerprints
from skyloom.llm.html import op7_html
from skyloom.llm.jpeg import op10_media
from skyloom.llm.kneser_ney import op4_kneser_ney
from skyloom.llm.langid import op9_langid
from skyloom.llm.licenses import op6_licenses
from skyloom.llm.mixing import op2_mixing
from skyloom.llm.repeats import op13_repeats
from skyloom.llm.set_join import op5_set_join
from skyloom.llm.toxicity import op8_toxicity
from skyloom.llm.vector_codes import op11_vector_codes

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_set_join": op5_set_join,
    "op6_licenses": op6_licenses,
    "op7_html": op7_html,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_media": op10_media,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_repeats": op13_repeats,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.oracle(), "op12_collocations": collocations.oracle()}
