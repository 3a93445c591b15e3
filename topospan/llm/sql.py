"""DuckDB SQL of the queries that SQL can express over whole tables."""

ORACLES: dict[str, str] = {}
