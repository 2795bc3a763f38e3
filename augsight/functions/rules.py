"""Deterministic rule classifier used as a stand-in model.

Predicts the language class of a text from characters that only some of
the four corpus languages use.  It is a plain Column expression, so the
prediction stays JVM-side and is reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes tested in this order; the first hit decides.
RULES = [
    ("de", "[äöüß]"),
    ("es", "[ñ¿¡áíóú]"),
    ("fr", "[éèêàçùâîô]"),
]
DEFAULT = "en"


def predict_language(text: str | Column) -> Column:
    """Language of a whole text: the first class with a hit."""
    t = F.col(text) if isinstance(text, str) else text
    expr = None
    for label, pattern in RULES:
        hit = F.coalesce(t.rlike(pattern), F.lit(False))
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(F.lit(DEFAULT))
