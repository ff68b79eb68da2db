"""Queries of the corpus operators and the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hash_tree, imatch, line_runs, nbsvm, packing, partenum, pieces, resample, secrets_dfa, suffix_levels, templates, turns, url_rules


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_template_decontamination": templates.query,
        "op2_ffd_packing": packing.query,
        "op3_url_rules": url_rules.query,
        "op4_hash_tree": hash_tree.query,
        "op5_nbsvm_quality": nbsvm.query,
        "op6_secret_automaton": secrets_dfa.query,
        "op7_partenum_join": partenum.query,
        "op8_line_runs": line_runs.query,
        "op9_imatch": imatch.query,
        "op10_suffix_levels": suffix_levels.query,
        "op11_piece_backtracking": pieces.query,
        "op12_turn_repair": turns.query,
        "op13_importance_resampling": resample.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": url_rules.SQL, "op8_line_runs": line_runs.SQL}
