"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import sql
from .align import op13_tokenizer_alignment
from .centroids import op12_centroid_clustering
from .exact_dedup import op2_exact_dedup
from .html_render import op3_html_rendering
from .jaccard import op5_ngram_jaccard_join
from .langid import op8_language_id
from .line_dedup import op11_line_dedup
from .mixing import op4_source_mixing
from .packing import op10_packing
from .reshard import op7_resharding
from .substring import op1_substring_dedup
from .toxicity import op9_toxicity
from .vectors import op6_embedding_near_dedup


def queries():
    import corpus_pipeline

    own = [op1_substring_dedup, op2_exact_dedup, op3_html_rendering, op4_source_mixing, op5_ngram_jaccard_join, op6_embedding_near_dedup, op7_resharding, op8_language_id, op9_toxicity, op10_packing, op11_line_dedup, op12_centroid_clustering, op13_tokenizer_alignment]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return dict(sql.ORACLES)
