"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, infill, licenses, ngram_join, packing, quality, repair, spotsigs, suffix_dedup, token_files, urls, warc

QUERIES = {
    "op1_warc_salvage": warc.op1_warc_salvage,
    "op2_preference_format": chat.op2_preference_format,
    "op3_simhash_decontamination": decontaminate.op3_simhash_decontamination,
    "op4_nnls_packing": packing.op4_nnls_packing,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "op6_additive_quality": quality.op6_additive_quality,
    "op7_sentence_licences": licenses.op7_sentence_licences,
    "op8_token_group_join": ngram_join.op8_token_group_join,
    "op9_url_trees": urls.op9_url_trees,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_agenda_repair": repair.op11_agenda_repair,
    "op12_patched_ids": token_files.op12_patched_ids,
    "op13_learned_infill": infill.op13_learned_infill,
}

ORACLE_SQL = {
    "op1_warc_salvage": warc.OP1_SQL,
    "op2_preference_format": chat.OP2_SQL,
    "op7_sentence_licences": licenses.ORACLE,
    "op11_agenda_repair": repair.OP11_SQL,
    "op13_learned_infill": infill.OP13_SQL,
}
