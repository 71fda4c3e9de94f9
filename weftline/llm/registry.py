"""Queries of the corpus operators over the test tables, and SQL for those that SQL can express."""

from weftline.llm.binary import op4_binary
from weftline.llm.decontaminate import op6_decontaminate
from weftline.llm.fertility import op8_rules
from weftline.llm.html import op7_html
from weftline.llm.langid import op1_language
from weftline.llm.packing import op2_packing
from weftline.llm.quality import op3_quality
from weftline.llm.simhash import op10_simhash
from weftline.llm.substrings import OP9_SQL, op9_substrings
from weftline.llm.urls import op5_urls

QUERIES = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_binary": op4_binary,
    "op5_urls": op5_urls,
    "op6_decontaminate": op6_decontaminate,
    "op7_html": op7_html,
    "op8_rules": op8_rules,
    "op9_substrings": op9_substrings,
    "op10_simhash": op10_simhash,
}
SQL = {"op9_substrings": OP9_SQL}
