"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from .chat import OP12_SQL, op12_reply_paths
from .embeddings import OP6_SQL, op6_hyperplane_tables
from .html import op2_host_suffix_array
from .idfiles import op5_dictionary_id_files
from .mixing import op8_prefix_sum_mix
from .negatives import OP11_SQL, op11_product_quantised
from .packing import op4_best_fit_decreasing
from .quality import op10_byte_cnn
from .sharding import op1_sampled_splitters
from .simhash import op3_simhash_pigeonhole
from .spelling import op13_positional_qgrams
from .topk import OP9_SQL, op9_term_at_a_time
from .warc import OP7_SQL, op7_seekable_bundles

QUERIES = {
    f.__name__: f
    for f in (
        op1_sampled_splitters,
        op2_host_suffix_array,
        op3_simhash_pigeonhole,
        op4_best_fit_decreasing,
        op5_dictionary_id_files,
        op6_hyperplane_tables,
        op7_seekable_bundles,
        op8_prefix_sum_mix,
        op9_term_at_a_time,
        op10_byte_cnn,
        op11_product_quantised,
        op12_reply_paths,
        op13_positional_qgrams,
    )
}

ORACLE_SQL = {
    op6_hyperplane_tables.__name__: OP6_SQL,
    op7_seekable_bundles.__name__: OP7_SQL,
    op9_term_at_a_time.__name__: OP9_SQL,
    op11_product_quantised.__name__: OP11_SQL,
    op12_reply_paths.__name__: OP12_SQL,
}
