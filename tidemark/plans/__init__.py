"""Parameters, registered queries and their SQL oracles."""
