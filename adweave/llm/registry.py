"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from adweave.llm import chat_format, filter_audit, language_id, line_cleaning, mixing, ngram_join, packing, paragraph_sketch, personal_data, secrets, sharding, spelling_groups, toxicity


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_paragraph_sketch": paragraph_sketch.op2_paragraph_sketch,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sharding": sharding.op4_sharding,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_mixing": mixing.op6_mixing,
        "op7_line_cleaning": line_cleaning.op7_line_cleaning,
        "op8_packing": packing.op8_packing,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_secrets": secrets.op10_secrets,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_spelling_groups": spelling_groups.op12_spelling_groups,
        "op13_personal_data": personal_data.op13_personal_data,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat_format.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_spelling_groups": spelling_groups.ORACLE}
