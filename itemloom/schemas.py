"""Explicit schemas; readers never infer."""

from __future__ import annotations

QUESTION = """
id STRING, content_hash STRING,
certification STRUCT<slug: STRING, name: STRING, vendor: STRING, level: STRING>,
exam STRUCT<slug: STRING, title: STRING, number: INT, mode: STRING, question_number: INT>,
domain STRING, type STRING, select_count INT, prompt_md STRING,
options ARRAY<STRUCT<label: STRING, text_md: STRING, correct: BOOLEAN, explanation_md: STRING>>,
correct_labels ARRAY<STRING>, overall_explanation_md STRING, `references` ARRAY<STRING>,
source STRUCT<provider: STRING, course_url: STRING, file: STRING>, origin STRING
"""

BLUEPRINT = """
id STRING, certification STRING, name STRING, vendor STRING, version_label STRING,
effective_from STRING, weight_regime STRING, weights_sum DOUBLE, weights_sum_max DOUBLE,
weights_sum_to_100 BOOLEAN, max_depth INT, levels ARRAY<STRING>,
sources ARRAY<STRUCT<path: STRING, sha256: STRING, kind: STRING, retrieved_on: STRING, note: STRING>>,
nodes ARRAY<STRUCT<path: STRING, depth: INT, ordinal: INT, kind: STRING, label: STRING,
  weight_pct: DOUBLE, weight_min: DOUBLE, weight_max: DOUBLE>>
"""

# ---- fixed values: accepted vocabularies ----
MARK_VALUES = ("known", "unsure", "flagged", "cleared")
WEIGHT_REGIMES = ("exact", "range", "absent", "unpublished")
ORIGINS = ("vendor_dump", "official_sample", "local_generation", "hand_written")

# ---- fixed values: provider -> origin ----
ORIGIN_FOR_PROVIDER = {
    "udemy": "vendor_dump",
    "official_sample": "official_sample",
    "local_generation": "local_generation",
    "hand_written": "hand_written",
}
