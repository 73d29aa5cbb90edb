"""N-grams of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions.columns import column


def ngrams(items: Column | str, n: int) -> Column:
    """All runs of n neighbouring elements of an array of any type, in order.

    A null array gives null, an array with fewer than n elements an empty array; null
    elements are elements like any other. n must be a positive int.
    """
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("ngrams: n must be an int")
    if n <= 0:
        raise ValueError("ngrams: n must be positive")
    a = column(items)
    runs = F.greatest(F.size(a) - n + 1, F.lit(0))
    # The i-th shifted array holds the i-th element of every run. The lambda looks at its own
    # argument alone: an outer column in it could be taken for an alias of the same select.
    shifted = F.arrays_zip(*(F.slice(a, i + 1, runs) for i in range(n)))
    return F.transform(shifted, lambda x: F.array(*(x[str(i)] for i in range(n))))
