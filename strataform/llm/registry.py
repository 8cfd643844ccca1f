"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, katz, quality, secrets, simhash, token_counts, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_url_filter": url_filter.op2,
    "op3_secret_scan": secrets.op3,
    "op4_warc": warc.op4,
    "op5_quality": quality.op5,
    "op6_katz": katz.op6,
    "op7_bpe": bpe.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_token_counts": token_counts.op9,
    "op10_simhash": simhash.op10,
}
ORACLES = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op2_url_filter": url_filter.OP2_SQL, "op4_warc": warc.OP4_SQL}
