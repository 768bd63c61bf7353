from tidemark.operators.indexes import (
    StagedIndex,
    build_ivf_index,
    build_scalar_index,
    drop_index,
    list_indexes,
    match_index,
)
from tidemark.operators.searches import (
    filter_rows,
    probed_lists,
    search_scalar,
    search_vector,
    search_vector_batch,
)
from tidemark.operators.statistics import (
    column_statistics,
    frequent_values,
    merged_statistics,
    record_statistics,
)
from tidemark.operators.vector_search import vector_topk, vector_topk_batch

__all__ = [
    "StagedIndex",
    "build_ivf_index",
    "build_scalar_index",
    "column_statistics",
    "drop_index",
    "filter_rows",
    "frequent_values",
    "list_indexes",
    "match_index",
    "merged_statistics",
    "probed_lists",
    "record_statistics",
    "search_scalar",
    "search_vector",
    "search_vector_batch",
    "vector_topk",
    "vector_topk_batch",
]
