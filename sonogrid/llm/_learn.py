"""Bounded training samples by hashing ids, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def different(*cols: str) -> Column:
    """About how many different rows a group has; rows alike in all the columns count once."""
    return F.approx_count_distinct(F.xxhash64(*[F.col(c) for c in cols]))


def drawn(n_rows: int, wanted: int, *cols: str) -> Column:
    """True for about ``wanted`` of ``n_rows`` different rows, chosen by a hash of the columns; for all if there are no more.

    Rows alike in all the columns are chosen together: those who collect the
    rows merge them first, so a row that is repeated without bound counts once.
    """
    if n_rows <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit(17)), F.lit(1 << 30)) < F.lit(int(wanted / n_rows * (1 << 30)))


class Adam:
    """Adam steps on a list of numpy arrays."""

    def __init__(self, params, rate=0.01):
        import numpy as np

        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads):
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / ((v / (1 - 0.999**self.t)) ** 0.5 + 1e-8)
