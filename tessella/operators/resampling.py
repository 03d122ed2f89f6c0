"""Sampling, bootstrap and repetition of events."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import keyed_uniform
from tessella.schema import CODE

SEED = 31415
#: Largest mean of a Poisson number that is drawn at once.
PART = 30.0
#: Rows that a sample sorts at most, unless so many have one hash.
SORTED_ROWS = 10_000


def sample_rows(df: DataFrame, size: int | float, seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """Rows without replacement: an int is a number of rows, a float a share of them from 0 to 1.

    The order is that of a hash of the key columns (the whole row by default), so that a repetition or another partitioning takes the same
    rows. Counts by the hash's leading bits find the hash at which the sample ends; rows below it are taken as they pass, and only the few
    that share its leading bits are sorted.
    """
    if isinstance(size, bool) or not isinstance(size, int | float):
        raise ValueError("size is an int or a float")
    if isinstance(size, float):
        if not 0 <= size <= 1:
            raise ValueError("a share lies between 0 and 1")
        size = int(size * df.count())
    if size < 0:
        raise ValueError("a number of rows is not negative")
    name = F.concat_ws(":", *key) if key else F.xxhash64(*df.columns)
    ranked = df.withColumn("__r", (keyed_uniform(name, seed) * float(1 << 52)).cast("long"))
    low, bits, left = 0, 52, size  # the sample ends among the hashes from low on, 2 ** bits of them, and takes so many rows there
    while bits:
        bits -= 13
        counts = {r.at: r.n for r in ranked.where((F.col("__r") >= low) & (F.col("__r") < low + (1 << bits + 13))).groupBy(F.shiftright(F.col("__r") - low, bits).alias("at")).agg(F.count("*").alias("n")).collect()}  # 8,192 rows at most
        for at in sorted(counts):
            if counts[at] > left:
                break
            left -= counts[at]
        else:
            return df.where("false") if not size else ranked.where(F.col("__r") < low + (1 << bits + 13)).drop("__r")
        low += at << bits
        if not left or counts[at] <= SORTED_ROWS:
            break
    taken = ranked.where(F.col("__r") < low)
    if left:
        taken = taken.unionByName(ranked.where((F.col("__r") >= low) & (F.col("__r") < low + (1 << bits))).orderBy("__r", *([] if key else df.columns)).limit(left))
    return taken.drop("__r")


def shuffled(df: DataFrame, seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """In the order of a hash of the key columns (the whole row by default)."""
    return df.orderBy(keyed_uniform(F.concat_ws(":", *key) if key else F.xxhash64(*df.columns), seed))


def split_by_process(events: DataFrame) -> dict[str, DataFrame]:
    return {p: events.where(F.col("label") == c) for p, c in CODE.items()}


def repeat_by_weight(events: DataFrame, weight: str = "weight") -> DataFrame:
    """Each event int(weight) times, without the weight; under 1 it goes."""
    n = F.col(weight).cast("int")
    return events.where(n >= 1).withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).drop("__copy", weight)


def _fractions(digests: bytes) -> np.ndarray:
    """Four draws of 52 bits from the first 26 bytes of each digest of 32."""
    words = np.frombuffer(digests, ">u8").reshape(-1, 4).astype(np.uint64)
    a, b, c, d = words.T
    bits = lambda x, n: x >> np.uint64(64 - n)
    low = np.uint64((1 << 52) - 1)
    parts = (bits(a, 52), (a << np.uint64(40) | bits(b, 40)) & low, (b << np.uint64(28) | bits(c, 28)) & low, (c << np.uint64(16) | bits(d, 16)) & low)
    return np.column_stack(parts).astype(np.float64) / float(1 << 52)


def poisson_numbers(keys: list[str], means: np.ndarray) -> np.ndarray:
    """A Poisson number for each key (rows) and mean (columns), by inversion of the key's draws (those of keyed_uniform).

    A large mean is the sum of parts of PART at most, each drawn on its own, so the distribution is exact at every size.
    """
    tails = [f":{b}".encode() for b in range(-(-means.shape[1] // 4))]
    digests = b"".join(hashlib.sha256(key + tail).digest() for key in map(str.encode, keys) for tail in tails)
    draws = _fractions(digests).reshape(len(keys), 4 * len(tails))[:, : means.shape[1]].copy()
    out, rest = np.zeros(means.shape, np.int64), np.nan_to_num(means)
    parts = np.maximum(1, np.ceil(rest / PART).astype(np.int64))
    for part in range(int(parts.max(initial=1))):
        rows, columns = np.nonzero((rest > 0) & (parts > part))
        if part:
            draws[rows, columns] = [int(hashlib.sha256(f"{keys[i]}:{k}:{part}".encode()).hexdigest()[:13], 16) / float(1 << 52) for i, k in zip(rows.tolist(), columns.tolist(), strict=True)]
        m, u = rest[rows, columns] / parts[rows, columns], draws[rows, columns]
        p = np.exp(-m)
        reach, n, open_, at = p.copy(), np.zeros(len(m), np.int64), np.arange(len(m)), 0
        while at < 10 * PART:
            over = u > reach
            if not (left := np.count_nonzero(over)):
                break
            if 2 * left < len(over):
                m, u, p, reach, open_, over = m[over], u[over], p[over], reach[over], open_[over], np.ones(left, bool)
            at += 1
            n[open_] += over
            p *= m / at
            reach += p
        out[rows, columns] += n
    return out


def with_replicates(df: DataFrame, name: str, means: list[Column], seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """df with an array of Poisson numbers, one of each mean: replicates of a bootstrap from one pass, without repeating rows.

    Numbers follow the key columns and the place of the mean, so they are the same however often and wherever they are drawn; rows with one
    key get the same numbers. Without a key they follow the row's place in its partition. A mean that is null, NaN or not positive gives 0.
    """

    width = len(means)

    @F.pandas_udf("array<int>")
    def draw(keys: pd.Series, values: pd.Series) -> pd.Series:
        rows = (np.concatenate(values.to_list()) if len(values) else np.empty(0)).reshape(len(values), width)
        return pd.Series(list(poisson_numbers(keys.tolist(), rows).astype(np.int32)))

    label = F.concat_ws(":", F.lit(str(seed)), *([F.col(k) for k in key] if key else [F.monotonically_increasing_id()]))
    return df.withColumn(name, draw(label, F.array(*(F.coalesce(m.cast("double"), F.lit(0.0)) for m in means))))


def with_poisson(df: DataFrame, name: str, mean: Column, seed: int, key: list[str] | None = None) -> DataFrame:
    """df with one Poisson number."""
    drawn = with_replicates(df, "__n", [mean], seed, key)
    return drawn.withColumn(name, F.col("__n")[0]).drop("__n")


def replicate_yields(events: DataFrame, replicates: int, *by: str, weight: str = "weight", seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """(by, replicate, yield): what bootstrap replicates of the events count, all from one scan."""
    drawn = with_replicates(events, "__n", [F.col(weight)] * replicates, seed, key)
    sums = drawn.groupBy(*by).agg(*(F.sum(F.col("__n")[k]).alias(f"__{k}") for k in range(replicates)))
    return sums.select(*by, F.posexplode(F.array(*(F.col(f"__{k}") for k in range(replicates)))).alias("replicate", "yield"))


def bootstrap(events: DataFrame, mu: float = 1.0, background: float | None = None, ttbar: float | None = None, diboson: float | None = None, draw: bool = True, seed: int = SEED,
              key: list[str] | None = None) -> DataFrame:
    """Toy events: each event as often as a Poisson number of its scaled weight (draw), or as that weight cut to an int.

    The signal is scaled by mu, ztautau by background, ttbar and diboson by background times their own scale, if that is given.
    """
    rest = 1.0 if background is None else background
    scales = {"htautau": mu, "ztautau": rest, "ttbar": 1.0 if ttbar is None else ttbar * rest, "diboson": 1.0 if diboson is None else diboson * rest}
    scale = F.lit(1.0)
    for process, s in scales.items():
        scale = F.when(F.col("label") == CODE[process], F.lit(float(s))).otherwise(scale)
    scaled = events.withColumn("weight", F.col("weight") * scale)
    if draw:
        scaled = with_poisson(scaled, "weight", F.col("weight"), seed, key)
    toys = repeat_by_weight(scaled.where("weight > 0"))
    return shuffled(toys, seed) if draw else toys
