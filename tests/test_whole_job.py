"""Queries whose SQL had lost columns or kinds of input: they have them again."""

import pytest
from lodestone.plans import code, hosting  # noqa: F401 - add their queries
from lodestone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Query, a column, and values that must be among it.
CASES = [
    ("exports_table", "kind", {"function", "class", "component", "type"}),
    ("exports_table", "is_default", {True, False}),
    ("import_sources", "external", {True, False}),
    ("classes_table", "interfaces", {"", "Closable|Open"}),
    ("classes_table", "is_abstract", {True, False}),
    ("import_specifiers", "is_default", {True, False}),
    ("commit_dump", "n_parents", {1, 2}),
    ("commit_dump", "author_login", {None}),
    ("blame_dump", "author_login", {None, "user1"}),
    ("blame_dump", "sha", {"c1"}),
    ("repository_metrics", "languages", set()),
    ("repository_urls", "owner", {None}),
    ("repository_urls", "link", {None}),
    ("path_functions", "resolved", {None}),
    ("graph_health", "note", {"1 connector file would split the graph", "2 files imported by more than 30% of the project"}),
    ("ai_verdicts", "reasoning", {"no idea"}),
    ("ai_verdicts", "suggested_severity", {"critical", None}),
]


@pytest.mark.parametrize("name, column, values", CASES)
def test_column_and_values(spark, name, column, values):
    found = {r[0] for r in QUERIES[name](spark, SF).select(column).distinct().collect()}
    assert values <= found and len(found) > 1
