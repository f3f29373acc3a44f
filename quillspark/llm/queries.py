"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quillspark.llm import lines, rules
from quillspark.llm.fingerprints import op8_fingerprints
from quillspark.llm.langid import op2_language_id
from quillspark.llm.lines import op7_line_dedup
from quillspark.llm.mixing import op3_source_mix
from quillspark.llm.pieces import op4_sentencepiece
from quillspark.llm.quality import op5_quality_classifier
from quillspark.llm.rules import op10_quality_rules
from quillspark.llm.simhash import op1_simhash
from quillspark.llm.substrings import op9_substring_dedup
from quillspark.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_simhash, op2_language_id, op3_source_mix, op4_sentencepiece, op5_quality_classifier, op6_toxicity, op7_line_dedup, op8_fingerprints, op9_substring_dedup, op10_quality_rules)}
ORACLES = {"op7_line_dedup": lines.SQL, "op10_quality_rules": rules.SQL}
