"""Registry of the corpus queries with their SQL twins."""

from __future__ import annotations

from .decontam import op8_decontamination
from .dedup import OP3_SQL, op3_exact_dedup
from .html import op4_html_text
from .langid import op1_language_id
from .lengths import op9_token_lengths
from .neardup import op7_near_duplicates
from .pieces import op5_sentencepiece
from .pii import op10_personal_data
from .quality import op6_quality
from .secrets import OP2_SQL, op2_secret_scan
from .spelling import op11_spelling_variants
from .suffixes import op12_suffix_dedup


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_secret_scan": op2_secret_scan,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_html_text": op4_html_text,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_quality": op6_quality,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_decontamination": op8_decontamination,
        "op9_token_lengths": op9_token_lengths,
        "op10_personal_data": op10_personal_data,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_suffix_dedup": op12_suffix_dedup,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op2_secret_scan": OP2_SQL, "op3_exact_dedup": OP3_SQL}
