"""Compositions of operators: risk ranking, territory report, registered queries."""
