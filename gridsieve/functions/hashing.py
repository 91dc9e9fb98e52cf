"""Key hashing: every random choice is a function of a row key and a seed.

A result therefore does not depend on partitioning, retries or executor loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

# Cumulative Poisson(1) probabilities P(X<=0) .. P(X<=11). What is left beyond 12 is below 2^-32, the
# resolution of a draw, so the largest draws give 12 and no count is cut.
POISSON1_CDF = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def row_key(cols: Sequence[str | Column]) -> Column:
    """One string key from the given columns, ``|``-separated."""
    return F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def hash32(key: Column | str, seed: int | str | Column = 42) -> Column:
    """Unsigned 32-bit hash: the first eight hex digits of md5(key || '-' || seed)."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat(key.cast("string"), F.lit("-"), seed.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(key: Column | str, seed: int | str | Column = 42) -> Column:
    """Hash mapped to [0, 1)."""
    return hash32(key, seed) / F.lit(TWO_32)


DRAWS_PER_DIGEST = 4


def digest_draws(key: Column, block: Column | int, seed: int | str = 42) -> Column:
    """md5(key || '#' || block || '-' || seed): four 32-bit draws of eight hex digits each.

    Members 4b .. 4b+3 take their draws from block b, so a digest serves four members.
    """
    block = F.lit(block) if isinstance(block, int) else block
    return F.md5(F.concat(key.cast("string"), F.lit("#"), block.cast("string"), F.lit(f"-{seed}")))


def poisson1_hex(digits: Column) -> Column:
    """Poisson(1) count from eight hex digits; fixed-width hex text compares like the number."""
    out = F.lit(len(POISSON1_CDF))
    for count in range(len(POISSON1_CDF) - 1, -1, -1):
        limit = f"{math.ceil(POISSON1_CDF[count] * TWO_32):08x}"
        out = F.when(digits < F.lit(limit), F.lit(count)).otherwise(out)
    return out.cast("int")


#: Least draws of the counts 1, 2, ..
POISSON1_LIMITS = tuple(math.ceil(c * TWO_32) for c in POISSON1_CDF)


def poisson1_counts(digests: Sequence[str], n_members: int) -> np.ndarray:
    """Rows x members: Poisson(1) counts of rows' joined digests, the counts of ``poisson1_hex``."""
    draws = np.frombuffer(bytes.fromhex("".join(digests)), dtype=">u4").reshape(len(digests), -1)[:, :n_members].astype(np.uint32)
    counts = np.zeros(draws.shape, np.uint8)
    for limit in POISSON1_LIMITS:
        counts += draws >= limit
    return counts


def member_poisson(key: Column, member: int, seed: int | str = 42) -> Column:
    """The bootstrap weight of one member."""
    digest = digest_draws(key, member // DRAWS_PER_DIGEST, seed)
    return poisson1_hex(F.substring(digest, member % DRAWS_PER_DIGEST * 8 + 1, 8))
