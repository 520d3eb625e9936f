"""DuckDB statements that state each query independently of the Spark code."""

from oracles import queries_a, queries_b

ORACLES: dict[str, str] = {**queries_a.ORACLES, **queries_b.ORACLES}
