"""Registered queries and their DuckDB SQL, over the carrier views of the test tables."""
