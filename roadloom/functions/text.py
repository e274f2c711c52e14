"""Column functions on names, ids and coordinate strings."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from roadloom.functions.geo import point

#: Full-width letters, digits and marks beside their ASCII forms, the compass signs and the numerals.
WIDE = "".join(chr(0xFF01 + i) for i in range(94))
NARROW = "".join(chr(0x21 + i) for i in range(94))
COMPASS = "東西南北"
NUMERALS = "一二三四五六七八九"


def narrow(name: Column) -> Column:
    """Full-width forms to ASCII, white space of all kinds away."""
    return F.regexp_replace(F.translate(name, WIDE, NARROW), "[\\s\\x{3000}]+", "")


def travel_direction(name: Column) -> Column:
    """The last sign if the last two are compass signs, else null."""
    found = F.regexp_extract(narrow(name), f"[{COMPASS}]([{COMPASS}])$", 1)
    return F.when(found != "", found)


def grid_address(name: Column) -> dict[str, Column]:
    """ns, n, ew, m as columns, null where the name is no such address."""
    plain = F.regexp_replace(narrow(name), f"[{COMPASS}]{{2}}$", "")
    pattern = "^([北南])([0-9]+)([東西])([0-9]+)"
    part = lambda k: F.nullif(F.regexp_extract(plain, pattern, k), F.lit(""))
    return {"ns": part(1), "n": part(2).cast("int"), "ew": part(3), "m": part(4).cast("int")}


def base_id(name: Column) -> Column:
    """The number before the first dot; null if it is none."""
    return F.substring_index(name, ".", 1).try_cast("bigint")


def kanji_number(text: Column) -> Column:
    """Numerals up to 99, such as 二十一, as an integer; null if the text is none."""
    digits = F.translate(text, NUMERALS, "123456789")
    at = F.instr(digits, "十")
    tens = F.when(at == 1, F.lit(1)).otherwise(F.substring(digits, 1, 1).try_cast("int"))
    ones = F.when(at == F.length(digits), F.lit(0)).otherwise(F.substring_index(digits, "十", -1).try_cast("int"))
    return F.when(at == 0, digits.try_cast("int")).otherwise(tens * 10 + ones)


def parse_points(raw: Column) -> Column:
    """array<struct<x, y>> of ``lon lat;lon lat``; malformed tokens and points outside 122-154 E, 20-46 N go."""
    tokens = F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda t: F.split(F.trim(t), " +"))
    pairs = F.transform(F.filter(tokens, lambda t: F.size(t) == 2), lambda t: point(F.try_element_at(t, F.lit(1)).try_cast("double"), F.try_element_at(t, F.lit(2)).try_cast("double")))
    return F.filter(pairs, lambda p: p["x"].between(122, 154) & p["y"].between(20, 46))


def norm_key(value: Column) -> Column:
    """Trimmed, a trailing ``.0`` away; blank is null."""
    return F.nullif(F.regexp_replace(F.trim(value), "\\.0$", ""), F.lit(""))


def composite_key(*parts: Column) -> Column:
    """Parts joined by ``-``; null if any part is."""
    own = [norm_key(p) for p in parts]
    missing = own[0].isNull()
    for p in own[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws("-", *own))


@arrow_udf(StringType())
def compatible(names: pa.Array) -> pa.Array:
    """Names in Unicode's form NFKC, which Spark's own functions do not give; null stays null."""
    distinct = names.dictionary_encode()
    forms = [None if x is None else unicodedata.normalize("NFKC", x) for x in distinct.dictionary.to_pylist()]
    return pa.DictionaryArray.from_arrays(distinct.indices, pa.array(forms, pa.string())).cast(pa.string())


#: Fixed value: what follows a numeral that is a number and not a part of a name.
COUNTERS = "丁目|条|線|号|番|地割"


def town_key(name: Column) -> Column:
    """A town's name to compare by: NFKC forms (full-width letters to ASCII, half-width kana to full), numerals before a counter to digits, parts in brackets and
    white space away, small ke and ka written large."""
    mark = "\x01"
    parts = F.split(F.regexp_replace(compatible(name), f"([〇{NUMERALS}十]+)(?={COUNTERS})", f"{mark}$1{mark}"), mark)

    def number(run: Column) -> Column:
        digits = F.translate(run, "〇" + NUMERALS, "0123456789")
        ten = F.instr(digits, "十")
        tens = F.when(ten == 1, F.lit(1)).otherwise(F.substring(F.substring_index(digits, "十", 1), -1, 1).try_cast("int"))
        ones = F.coalesce(F.substring(F.substring_index(digits, "十", -1), -1, 1).try_cast("int"), F.lit(0))
        return F.when(ten == 0, ones).otherwise(F.when(tens == 0, 1).otherwise(tens) * 10 + ones).cast("string")

    read = F.array_join(F.transform(parts, lambda t, i: F.when(i % 2 == 1, number(t)).otherwise(t)), "")
    return F.translate(F.regexp_replace(F.regexp_replace(read, "\\(.*?\\)", ""), "\\s+", ""), "ヶヵ", "ケカ")


def mesh_of_file(path: Column) -> Column:
    """The 8-digit mesh code that a file's name starts with, else null."""
    return F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), "^([0-9]{8})_", 1), F.lit(""))
