"""Queries of this subpackage by name, and the SQL of those that SQL can express.

``QUERIES`` has op1 to op10, among which the pipeline's stages are; ``LATER`` has those that were dealt after them.
"""

from __future__ import annotations

from .alignment import op13_alignment
from .collocations import OP12_SQL, op12_collocations
from .decontamination import op10_decontamination
from .fingerprints import op4_fingerprints
from .jaccard import op3_ngram_jaccard
from .language_model import op6_language_model
from .line_quality import op11_line_quality
from .secret_scan import op7_secret_scan
from .sentencepieces import op5_sentencepieces
from .sharding import op2_sharding
from .suffixes import op9_suffix_dedup
from .toxicity import op8_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_sharding, op3_ngram_jaccard, op4_fingerprints, op5_sentencepieces,
        op6_language_model, op7_secret_scan, op8_toxicity, op9_suffix_dedup, op10_decontamination,
    )
}

LATER = {f.__name__: f for f in (op11_line_quality, op12_collocations, op13_alignment)}

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op12_collocations": OP12_SQL}
