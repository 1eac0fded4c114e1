"""Feature names, groups and the specification that selects among them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

# The historical features, in order (fixed values).
HISTORICAL_NAMES = [
    "user_query_count_norm",
    "user_heavy_rate",
    "user_avg_cpu_seconds_norm",
    "user_p90_cpu_seconds_norm",
    "user_avg_memory_gb_norm",
    "user_catalog_diversity_norm",
    "catalog_query_count_norm",
    "catalog_heavy_rate",
    "catalog_avg_cpu_seconds_norm",
    "catalog_p90_cpu_seconds_norm",
    "catalog_avg_memory_gb_norm",
    "catalog_user_diversity_norm",
    "schema_query_count_norm",
    "schema_heavy_rate",
    "schema_avg_cpu_seconds_norm",
    "schema_avg_memory_gb_norm",
    "is_cold_start",
]
VOCABULARY = 250


# The features of each group, in order (fixed values). They are written out, as columns need a session; a
# test holds them to the groups' columns.
GROUP_NAMES: dict[str, list[str]] = {
    "sql": [
        "query_length",
        "token_count",
        "line_count",
        "has_select_star",
        "has_distinct",
        "has_order_by",
        "has_limit",
        "limit_value",
        "has_offset",
        "comment_ratio",
        "parentheses_depth",
        "quoted_strings_count",
        "numeric_literals_count",
        "wildcard_count",
        "semicolon_count",
    ],
    "table_join": [
        "table_count",
        "join_count",
        "left_join_count",
        "inner_join_count",
        "cross_join_present",
        "full_outer_join_present",
        "self_join_count",
        "with_clause_count",
        "nested_with_depth",
        "recursive_cte_present",
        "subquery_in_from_count",
        "correlated_subquery_likely",
    ],
    "where": [
        "where_condition_count",
        "where_and_count",
        "where_or_count",
        "where_not_count",
        "in_clause_count",
        "in_list_total_items",
        "max_in_list_size",
        "between_count",
        "like_pattern_count",
        "exists_count",
    ],
    "aggregation": [
        "group_by_count",
        "having_clause_present",
        "count_function_count",
        "sum_avg_function_count",
        "min_max_function_count",
        "distinct_aggregation_count",
        "window_function_count",
        "unbounded_window_present",
    ],
    "structure": [
        "ast_depth",
        "ast_breadth",
        "ast_with_count",
        "ast_cte_count",
        "ast_lateral_view_count",
        "ast_window_func_count",
        "ast_distinct_count",
        "ast_having_count",
        "ast_case_when_count",
        "ast_coalesce_null_if_count",
    ],
    "context": [
        "user_hash",
        "catalog_hash",
        "schema_hash",
        "hour_of_day",
        "hour_sin",
        "hour_cos",
        "is_business_hours",
        "client_info_length",
    ],
    "query_type": [
        "is_select_query",
        "is_insert_query",
        "is_create_table_as",
        "is_delete_query",
        "is_update_query",
    ],
    "set_operation": [
        "except_count",
        "intersect_count",
        "set_operation_total",
        "has_multiple_statements",
    ],
    "null_aware": [
        "is_catalog_null",
        "is_schema_null",
        "has_qualified_tables",
        "inferred_catalog_count",
        "inferred_schema_count",
        "table_qualification_level",
    ],
}


def base_names() -> list[str]:
    """The base features in order."""
    return [n for names in GROUP_NAMES.values() for n in names]


@dataclass
class FeatureGroup:
    """Features that are switched together."""

    name: str
    feature_names: list[str]
    enabled: bool = True
    importance_scores: dict[str, float] = field(default_factory=dict)
    description: str = ""


@dataclass
class FeatureSpec:
    """Which features are active, in their fixed order.

    A feature without a known importance counts as fully important. Active names are worked out
    when asked for, so a threshold that is set later takes effect.
    """

    groups: list[FeatureGroup]
    disabled_features: set[str] = field(default_factory=set)
    importance_threshold: float = 0.0
    version: str = "1"

    @classmethod
    def default(cls, historical: bool = False) -> FeatureSpec:
        groups = [FeatureGroup(g, list(names)) for g, names in GROUP_NAMES.items()]
        if historical:
            groups.append(FeatureGroup("historical", list(HISTORICAL_NAMES)))
        return cls(groups)

    def all_names(self) -> list[str]:
        return [n for g in self.groups for n in g.feature_names]

    def _important(self, group: FeatureGroup, name: str) -> bool:
        return group.importance_scores.get(name, 1.0) >= self.importance_threshold

    def active_names(self) -> list[str]:
        return [
            n for g in self.groups if g.enabled for n in g.feature_names
            if n not in self.disabled_features and self._important(g, n)
        ]

    def _group(self, name: str) -> FeatureGroup:
        for g in self.groups:
            if g.name == name:
                return g
        raise KeyError(f"no feature group {name!r}")

    def enable_group(self, name: str, enabled: bool = True) -> None:
        self._group(name).enabled = enabled

    def disable_group(self, name: str) -> None:
        self.enable_group(name, False)

    def enable_feature(self, name: str) -> None:
        self.disabled_features.discard(name)

    def disable_feature(self, name: str) -> None:
        if name not in self.all_names():
            raise KeyError(f"no feature {name!r}")
        self.disabled_features.add(name)

    def set_importance(self, scores: dict[str, float]) -> None:
        for g in self.groups:
            g.importance_scores |= {n: float(s) for n, s in scores.items() if n in g.feature_names}

    def importance_report(self, k: int = 10) -> dict[str, list[tuple[str, float]]]:
        """The k most and the k least important features; ties by name."""
        scores = [(n, g.importance_scores.get(n, 1.0)) for g in self.groups for n in g.feature_names]
        top = sorted(scores, key=lambda x: (-x[1], x[0]))
        return {"top": top[:k], "bottom": sorted(scores, key=lambda x: (x[1], x[0]))[:k]}

    def summary(self) -> list[dict]:
        """One row for each group: size, active features, whether it is on."""
        active = set(self.active_names())
        return [
            {"group": g.name, "features": len(g.feature_names), "active": sum(n in active for n in g.feature_names), "enabled": g.enabled}
            for g in self.groups
        ]

    def to_dict(self) -> dict:
        return asdict(self) | {"disabled_features": sorted(self.disabled_features)}

    @classmethod
    def from_dict(cls, data: dict) -> FeatureSpec:
        groups = [FeatureGroup(**g) for g in data["groups"]]
        return cls(groups, set(data.get("disabled_features", ())), data.get("importance_threshold", 0.0), data.get("version", "1"))

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FeatureSpec:
        return cls.from_dict(json.loads(text))
