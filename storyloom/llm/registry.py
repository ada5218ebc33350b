"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from storyloom.llm import decontamination, licenses, near_duplicates, repetition, spelling, vector_codes, warc
from storyloom.llm.decontamination import op5_decontamination
from storyloom.llm.language import op9_language
from storyloom.llm.licenses import op8_licenses
from storyloom.llm.near_duplicates import op2_jaccard
from storyloom.llm.neighbours import op10_neighbours
from storyloom.llm.packing import op3_packing
from storyloom.llm.quality import op6_quality
from storyloom.llm.repetition import op11_repetition
from storyloom.llm.secrets import op7_secrets
from storyloom.llm.spelling import op13_spelling
from storyloom.llm.toxicity import op1_toxicity
from storyloom.llm.vector_codes import op12_codes
from storyloom.llm.warc import op4_warc


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_jaccard": op2_jaccard,
        "op3_packing": op3_packing,
        "op4_warc": op4_warc,
        "op5_decontamination": op5_decontamination,
        "op6_quality": op6_quality,
        "op7_secrets": op7_secrets,
        "op8_licenses": op8_licenses,
        "op9_language": op9_language,
        "op10_neighbours": op10_neighbours,
        "op11_repetition": op11_repetition,
        "op12_codes": op12_codes,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": near_duplicates.ORACLE, "op4_warc": warc.ORACLE, "op5_decontamination": decontamination.ORACLE, "op8_licenses": licenses.ORACLE, "op11_repetition": repetition.ORACLE, "op12_codes": vector_codes.ORACLE, "op13_spelling": spelling.ORACLE}
