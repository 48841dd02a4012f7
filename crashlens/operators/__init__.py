"""Reusable DataFrame operators."""

from crashlens.operators.dedup import count_entities, dedup_by_key, distinct_entities
from crashlens.operators.groups import (conditional_count, count_distinct_by, count_distinct_ids, group_count,
                                        group_sum, groups_with_more_than, groups_without)
from crashlens.operators.joins import join_on, restrict_to
from crashlens.operators.profile import (heavy_values, key_counts, largest_keys, missing_counts, profile_table,
                                         sample_entities, schema_rows, value_counts)
from crashlens.operators.ranking import deep_rank_band, global_ranks, rank_band, top_k, top_k_count, top_per_group

__all__ = [
    "count_entities", "dedup_by_key", "distinct_entities",
    "conditional_count", "count_distinct_by", "count_distinct_ids", "group_count", "group_sum",
    "groups_with_more_than", "groups_without",
    "join_on", "restrict_to",
    "heavy_values", "key_counts", "largest_keys", "missing_counts", "profile_table", "sample_entities", "schema_rows",
    "value_counts",
    "deep_rank_band", "global_ranks", "rank_band", "top_k", "top_k_count", "top_per_group",
]
