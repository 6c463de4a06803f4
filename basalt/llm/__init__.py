"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` holds the thin ``opN_<name>`` queries and ``oracles`` their DuckDB SQL.
"""
