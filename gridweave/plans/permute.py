"""Shuffles by arithmetic: a keyed permutation of 0..n-1 that is computed, forwards and backwards, for each number alone.

A number is split into two digits, whose ranges multiply to n or little more; a Feistel network adds a keyed hash of one digit to the other, a few
times in turn. What leaves 0..n-1 goes through the network again until it is back; so few numbers are outside that the longest such walk is found
when the plan is built, and the plan has that many networks and no loop. A hash uses its digit once, so that the expression stays short
and is compiled. Neither direction needs an exchange: a row knows its position, and a step knows its rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the network, and the primes that its hashes are taken modulo of in turn.
ROUNDS, PRIMES = 4, (2_147_483_647, 2_147_483_629, 2_147_483_587)
LARGEST = 1 << 60
#: Ranges of the lower digit that are tried for the least numbers outside.
TRIED = 4096


class Permutation:
    """The permutations of 0..n-1 that belong to a seed, one for each epoch."""

    def __init__(self, n: int, seed: int):
        if not 0 <= n <= LARGEST:
            raise ValueError("a permutation has up to 2^60 places")
        self.n, self.seed = n, seed
        root = math.isqrt(max(n - 1, 0)) + 1
        # of the two digits' ranges: near the root, with the least numbers outside
        self.low = min(range(root, root + min(TRIED, 1 + root // 2)), key=lambda a: (-n % a, a))
        self.high = -(-n // self.low)
        said = hashlib.sha512(f"permutation {seed}".encode()).digest()
        words = iter(1 + int.from_bytes(said[4 * k : 4 * k + 4], "little") % (PRIMES[-1] - 1) for k in range(16))
        #: What is added to the digit, what the epoch is multiplied by, and two multipliers, for each round.
        self.keys = [tuple(next(words) for _ in range(4)) for _ in range(ROUNDS)]

    # --- numpy ---

    def _hash(self, y: np.ndarray, k: int, epoch: int) -> np.ndarray:
        add, slope, first, second = self.keys[k]
        t = (y + (add + epoch % PRIMES[0] * slope) % PRIMES[0]) % PRIMES[0]
        return ((t * first % PRIMES[1]) ^ slope) * second % PRIMES[2] ^ add

    def _network(self, x: np.ndarray, epoch: int, back: bool) -> np.ndarray:
        left, right = x % self.low, x // self.low
        sign = -1 if back else 1
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2 == 0:
                left = (left + sign * (self._hash(right, k, epoch) % self.low)) % self.low
            else:
                right = (right + sign * (self._hash(left, k, epoch) % self.high)) % self.high
        return right * self.low + left

    def _walked(self, x, epoch: int, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        out = self._network(x, epoch, back)
        while (far := out >= self.n).any():
            out[far] = self._network(out[far], epoch, back)
        return out

    def positions(self, idx, epoch: int) -> np.ndarray:
        return self._walked(idx, epoch, False)

    def indices(self, positions, epoch: int) -> np.ndarray:
        return self._walked(positions, epoch, True)

    def walk(self, epochs: Sequence[int]) -> int:
        """The most times that any number goes through the network again in one of ``epochs``; both directions walk the same chains."""
        most = 0
        for epoch in epochs:
            x, k = np.arange(self.n, self.low * self.high, dtype=np.int64), 0
            x = x[self._network(x, epoch, True) < self.n]  # whose chains begin inside; others may go round outside for ever
            while len(x):
                x, k = self._network(x, epoch, False), k + 1
                x = x[x >= self.n]
            most = max(most, k)
        return most

    # --- columns ---

    def _column(self, x: Column, epoch: Column, epochs: Sequence[int], back: bool) -> Column:
        """``x`` through the network, in integer arithmetic."""
        long = lambda v: F.lit(v).cast("bigint")
        epoch = F.pmod(epoch.cast("bigint"), long(PRIMES[0]))

        def hashed(y: Column, k: int) -> Column:
            add, slope, first, second = self.keys[k]
            t = (y + (long(add) + epoch * long(slope)) % long(PRIMES[0])) % long(PRIMES[0])
            return ((t * long(first) % long(PRIMES[1])).bitwiseXOR(long(slope)) * long(second) % long(PRIMES[2])).bitwiseXOR(long(add))

        def network(v: Column) -> Column:
            left, right = v % long(self.low), F.call_function("div", v, long(self.low))
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                mine, other, size = (left, right, long(self.low)) if k % 2 == 0 else (right, left, long(self.high))
                moved = hashed(other, k) % size
                mine = F.pmod(mine - moved, size) if back else (mine + moved) % size
                left, right = (mine, other) if k % 2 == 0 else (other, mine)
            return right * long(self.low) + left

        x = network(x.cast("bigint"))
        for _ in range(self.walk(epochs)):
            x = F.when(x < self.n, x).otherwise(network(x))
        return x

    def with_positions(self, df: DataFrame, epochs: Sequence[int], idx: str = "idx", name: str = "pos") -> DataFrame:
        """Adds the place of each idx in the shuffle of its epoch; don't compute one direction from the other's expression, it grows."""
        return df.withColumn(name, self._column(F.col(idx), F.col("epoch"), epochs, False))

    def with_indices(self, df: DataFrame, epochs: Sequence[int], pos: str = "pos", name: str = "idx") -> DataFrame:
        """Adds the idx that stands at each place of its epoch's shuffle."""
        return df.withColumn(name, self._column(F.col(pos), F.col("epoch"), epochs, True))


def members(steps: DataFrame, n: int, batch_size: int, seed: int | None, epochs: Sequence[int]) -> DataFrame:
    """pos, pos_in_batch and idx of every item of ``steps(epoch, step, ...)``: without a look at the items, nor an exchange."""
    last = F.least((F.col("step") + 1) * batch_size, F.lit(n).cast("bigint")) - 1
    first = F.col("step") * batch_size
    rows = steps.where(first <= last).withColumn("pos", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("pos_in_batch", F.col("pos") - F.col("step") * batch_size)
    return rows.withColumn("idx", F.col("pos")) if seed is None else Permutation(n, seed).with_indices(rows, epochs)
