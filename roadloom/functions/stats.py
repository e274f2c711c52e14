"""Column functions of counts, ratios and fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash holdout takes a fifth of the units: 0.2 * 2**64 in hexadecimal.
HOLDOUT_LIMIT, HOLDOUT_SALT = "3333333333333333", "roadloom-holdout"


def dec(x: Column, digits: int = 3) -> Column:
    """Rounded by way of decimals, which every engine does alike, and given back as a double."""
    return x.cast("decimal(18,9)").cast(f"decimal(18,{digits})").cast("double")


def geh(model: Column, observed: Column) -> Column:
    """The GEH statistic; 0 where both are 0."""
    both = model + observed
    return F.when(both <= 0, F.lit(0.0)).otherwise(F.sqrt(2 * (model - observed) * (model - observed) / both))


def is_holdout(unit: Column, salt: str = HOLDOUT_SALT, limit: str = HOLDOUT_LIMIT) -> Column:
    """Whether the first eight bytes of SHA-256(salt:unit) lie in the lowest fifth."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), unit).cast("binary"), 256), 1, 16) <= limit


def sums(s: Column, o: Column) -> list[Column]:
    """Exact sums of a fit, of two decimal columns."""
    return [F.count("*").alias("n"), F.sum(s).alias("ss"), F.sum(o).alias("so"), F.sum(s * s).alias("sss"), F.sum(o * o).alias("soo"), F.sum(s * o).alias("sso")]


def fit_from_sums() -> dict[str, Column]:
    """r, r2, slope through the origin, RMSE in percent of the mean, volume ratio; null where a divisor is zero or n < 2."""
    n, ss, so, sss, soo, sso = (F.col(c).cast("double") for c in ("n", "ss", "so", "sss", "soo", "sso"))
    spread = (n * sss - ss * ss) * (n * soo - so * so)
    r = F.when((n >= 2) & (spread > 0), (n * sso - ss * so) / F.sqrt(spread))
    some = n >= 2
    return {
        "r": dec(r),
        "r2": dec(r * r),
        "slope": dec(F.when(some & (soo > 0), sso / soo)),
        "rmse_pct": dec(F.when(some & (so > 0), F.sqrt((sss - 2 * sso + soo) / n) / (so / n) * 100)),
        "ratio": dec(F.when(some & (so > 0), ss / so)),
    }
