"""All registered queries and their SQL."""

from lumenstep.plans import measures, modelling, relational  # noqa: F401
from lumenstep.plans._registry import ORACLE_SQL, QUERIES


def flagship(spark, sf_dir):
    """Fit on labelled documents, then score and explain every one of them."""
    return QUERIES["score_docs_categorical"](spark, sf_dir)
