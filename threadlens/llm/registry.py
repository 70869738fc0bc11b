"""Queries of the subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from threadlens.llm import automata, decontaminate, editprint, langid, licenses, packing, pieces, pseudonyms, secrets, simhash, tandem, variants, warc


def _pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_warc_revisits": warc.revisits_query,
    "op2_edit_fingerprints": editprint.fingerprint_query,
    "op3_secret_scan": secrets.secrets_query,
    "op4_licenses": licenses.licenses_query,
    "op5_pseudonyms": pseudonyms.pseudonyms_query,
    "op6_repeated_spans": automata.repeats_query,
    "op7_simhash_ball": simhash.simhash_query,
    "op8_decontaminate": decontaminate.decontaminate_query,
    "op9_pieces": pieces.pieces_query,
    "op10_language_id": langid.langid_query,
    "op11_best_fit_packing": packing.packing_query,
    "op12_spelling_variants": variants.variants_query,
    "op13_periodic_runs": tandem.runs_query,
    "pipeline": _pipeline,
}

ORACLE = {
    "op1_warc_revisits": warc.ORACLE_SQL,
    "op6_repeated_spans": automata.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
}
