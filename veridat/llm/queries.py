"""The queries of the corpus operators and the SQL that some of them are held against."""

from __future__ import annotations

from .op1_language import op1_language_id
from .op2_license import op2_license_scan
from .op3_pii import op3_pii
from .op4_lm_score import op4_lm_score
from .op5_decontaminate import OP5_SQL, op5_decontaminate
from .op6_jaccard import OP6_SQL, op6_ngram_jaccard
from .op7_quality import OP7_SQL, op7_quality_rules
from .op8_secrets import op8_secret_scan
from .op9_warc import OP9_SQL, op9_warc_revisit
from .op10_mixing import op10_mix_domains
from .op11_topk import OP11_SQL, op11_exact_topk
from .op12_centroids import OP12_SQL, op12_centroid_clusters
from .op13_alignment import op13_align_tokens


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_license_scan": op2_license_scan,
        "op3_pii": op3_pii,
        "op4_lm_score": op4_lm_score,
        "op5_decontaminate": op5_decontaminate,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_quality_rules": op7_quality_rules,
        "op8_secret_scan": op8_secret_scan,
        "op9_warc_revisit": op9_warc_revisit,
        "op10_mix_domains": op10_mix_domains,
        "op11_exact_topk": op11_exact_topk,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_align_tokens": op13_align_tokens,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_quality_rules": OP7_SQL, "op9_warc_revisit": OP9_SQL, "op11_exact_topk": OP11_SQL, "op12_centroid_clusters": OP12_SQL}
