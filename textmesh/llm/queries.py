"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from textmesh.llm.decontam import op3_decontamination
from textmesh.llm.langid import op8_language
from textmesh.llm.png_media import op7_media
from textmesh.llm.ppm import op4_ppm
from textmesh.llm.simhash import op9_simhash
from textmesh.llm.spiece import op10_sentencepiece
from textmesh.llm.substring import OP6_SQL, op6_substring
from textmesh.llm.toxicity import op1_toxicity
from textmesh.llm.url_lm import OP2_SQL, op2_url_filter
from textmesh.llm.warc import OP5_SQL, op5_warc_revisits

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_ppm": op4_ppm,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_substring": op6_substring,
    "op7_media": op7_media,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op5_warc_revisits": OP5_SQL, "op6_substring": OP6_SQL}
