"""The operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tidelog.llm import sql
from tidelog.llm.fingerprints import op3_fingerprints
from tidelog.llm.languages import op4_language_id
from tidelog.llm.licences import op7_license_scan
from tidelog.llm.neighbours import op8_neighbours
from tidelog.llm.ngram_join import op5_ngram_jaccard
from tidelog.llm.packing import op9_packing
from tidelog.llm.sentencepieces import op2_sentencepiece
from tidelog.llm.suffix_dedup import op1_suffix_dedup
from tidelog.llm.toxicity import op10_toxicity
from tidelog.llm.url_filters import op6_url_filters

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_url_filters": op6_url_filters,
    "op7_license_scan": op7_license_scan,
    "op8_neighbours": op8_neighbours,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

#: The classifiers, tokenizers, hashes and curves of the others are beyond SQL; tests hold them against brute force,
#: round trips, the libraries, or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": sql.OP1,
    "op5_ngram_jaccard": sql.OP5,
    "op7_license_scan": sql.OP7,
}
