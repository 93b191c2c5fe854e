"""Queries over the test tables, one for each operator, and their SQL."""

from leakscope.queries import audit, consensus, skewed, texts

REGISTRY = {**skewed.QUERIES, **texts.Q, **audit.Q, **consensus.Q}
SQL = {**skewed.SQL, **texts.SQL, **audit.SQL, **consensus.SQL}
FLAGSHIP = texts.exposure_ngram8
