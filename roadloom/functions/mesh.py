"""The statistics grid: 30 by 45 seconds of arc for the 8-digit code, an eighth of that each way for the 11-digit one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-9


def mesh6_index(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(column, row) of the 125 m cell; the guard keeps points on a border in the cell above it."""
    return F.floor((lon - 100) * 640 + GUARD).cast("long"), F.floor(lat * 960 + GUARD).cast("long")


def mesh3_code(ix: Column, iy: Column) -> Column:
    """The 8-digit code of the kilometre cell that holds cell (ix, iy)."""
    cx, cy = F.floor(ix / 8).cast("long"), F.floor(iy / 8).cast("long")
    part = lambda c: c.cast("string")
    return F.concat(
        F.lpad(part(F.floor(cy / 80).cast("long")), 2, "0"), F.lpad(part(F.floor(cx / 80).cast("long")), 2, "0"),
        part(F.pmod(F.floor(cy / 10).cast("long"), F.lit(8))), part(F.pmod(F.floor(cx / 10).cast("long"), F.lit(8))),
        part(F.pmod(cy, F.lit(10))), part(F.pmod(cx, F.lit(10))),
    )


def mesh6_code(ix: Column, iy: Column) -> Column:
    """The 11-digit code: a quadrant digit 1 to 4 for each of three halvings below the kilometre cell."""
    out = mesh3_code(ix, iy)
    for half in (4, 2, 1):
        quadrant = 1 + F.pmod(F.floor(ix / half).cast("long"), F.lit(2)) + 2 * F.pmod(F.floor(iy / half).cast("long"), F.lit(2))
        out = F.concat(out, quadrant.cast("string"))
    return out


def mesh6_bounds(ix: Column, iy: Column) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in degrees."""
    return ix / 640 + 100, iy / 960, (ix + 1) / 640 + 100, (iy + 1) / 960
