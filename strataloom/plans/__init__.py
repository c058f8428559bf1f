"""Query catalogues: each module gives QUERIES and, where SQL can say it, ORACLES."""
