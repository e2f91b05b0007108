"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from . import bpe, collocations, exact_dedup, langid, line_dedup, media, mixing, pii, resampling, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_language_id": langid.op6_language_id,
    "op7_media": media.op7_media,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc_audit": warc.op9_warc_audit,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_personal_data": pii.op11_personal_data,
    "op12_collocations": collocations.op12_collocations,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op9_warc_audit": warc.OP9_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
