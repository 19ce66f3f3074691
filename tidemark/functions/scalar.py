"""Column-level building blocks: null rules, calendar arithmetic, codes, positions.

Every function returns a `Column` built from JVM expressions, so it stays inside
whole-stage code generation and can be pushed towards the scan.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    """a / b as a double, NULL where b is zero or missing."""
    den = col(b).cast("double")
    return col(a).cast("double") / F.when(den != 0.0, den)


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; NULL for a constant or too few pairs.

    The built-in `corr` divides by zero there, which ANSI mode turns into a failed job.
    """
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    return div(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


# ------------------------------------------------------------------ missing values


def null_if(c: str | Column, *sentinels: float) -> Column:
    """Sentinels, NaN and infinities become NULL; everything downstream sees only NULL."""
    x = col(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    for s in sentinels:
        bad = bad | (x == F.lit(float(s)))
    return F.when(~bad, x)


# ------------------------------------------------------------------ text

def _bases(points: Iterable[int]) -> dict[str, str]:
    """Letters whose compatibility decomposition starts from ASCII, and what is left without marks."""
    found = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in points}
    return {c: base for c, base in found.items() if base}


#: Latin-1 letters, Latin Extended-A, -B and Additional, ligatures and full-width forms.
BASES = _bases([*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)])


def fold(c: str | Column) -> Column:
    """Form for comparing names: decomposed, ASCII only, lower case, trimmed.

    Letters keep their base, combining marks and everything else outside ASCII go. Texts that hold nothing
    outside ASCII, or no letter that becomes several, skip the steps that would find nothing.
    """
    text = col(c)
    single = {k: v for k, v in BASES.items() if len(v) == 1}
    wide = {k: v for k, v in BASES.items() if len(v) > 1}
    several = text
    for letters in sorted(set(wide.values())):
        several = F.regexp_replace(several, "[" + "".join(k for k, v in wide.items() if v == letters) + "]", letters)
    narrow = F.when(text.rlike("[" + "".join(wide) + "]"), several).otherwise(text)
    plain = F.regexp_replace(F.translate(narrow, "".join(single), "".join(single.values())), r"[^\x00-\x7F]+", "")
    return F.trim(F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(plain)))


def slug(c: str | Column) -> Column:
    """Lower-case identifier: folded, other runs of characters become one dash."""
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def starts_with_any(c: str | Column, prefixes: Sequence[str]) -> Column:
    """Folded prefix match against a short configured list."""
    name = fold(c)
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | name.startswith(fold(F.lit(p)))
    return hit


# ------------------------------------------------------------------ calendar


def weekday_index(d: str | Column) -> Column:
    """Monday-based count of Mon-Fri days up to (not including) the date."""
    u = F.unix_date(col(d)) + F.lit(3)
    return F.lit(5) * F.floor(u / F.lit(7)) + F.least(F.pmod(u, F.lit(7)), F.lit(5))


def busdays(a: str | Column, b: str | Column) -> Column:
    """Mon-Fri days in [a, b), closed form, no UDF."""
    return (weekday_index(b) - weekday_index(a)).cast("long")


def prev_sunday(d: str | Column) -> Column:
    """The last Sunday strictly before a release; a Sunday release looks back a full week."""
    dow = F.dayofweek(col(d))
    return F.date_sub(col(d), F.when(dow == 1, 7).otherwise(dow - 1))


def week_fri(d: str | Column) -> Column:
    """Friday that closes the Saturday..Friday week of a date."""
    monday = F.to_date(F.date_trunc("week", F.date_add(col(d), 2)))
    return F.date_add(monday, 4)


def in_months(d: str | Column, start: int, end: int) -> Column:
    """Season predicate; start > end wraps over New Year."""
    m = F.month(col(d))
    if start <= end:
        return m.between(start, end)
    return (m >= start) | (m <= end)


def crop_year(d: str | Column, calendar: Sequence[tuple[int, int]]) -> Column:
    """(month, offset) calendar to the season's year; months outside it give NULL."""
    out = F.lit(None).cast("int")
    for month, offset in calendar:
        out = F.when(F.month(col(d)) == month, F.year(col(d)) - F.lit(offset)).otherwise(out)
    return out


def month_cycle(d: str | Column, origin: int = 0) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*(month - origin)/12."""
    phase = F.lit(2.0 * math.pi) * (F.month(col(d)) - F.lit(origin)) / F.lit(12.0)
    return F.sin(phase), F.cos(phase)


# ------------------------------------------------------------------ measures


def excess(c: str | Column, threshold: float) -> Column:
    """How far above a threshold, never below zero; NULL stays NULL."""
    x = col(c)
    return F.when(x > threshold, x - F.lit(threshold)).when(x.isNotNull(), F.lit(0.0))


def signed_anomaly(probability: str | Column, category: str | Column, tercile: float = 100.0 / 3.0) -> Column:
    """Probability above climatology, signed by the leaning; Normal is zero."""
    p, c = col(probability), F.lower(col(category))
    return (
        F.when(c == "above", p - F.lit(tercile))
        .when(c == "below", F.lit(tercile) - p)
        .when(c == "normal", F.lit(0.0))
    )


def on_tick(c: str | Column, tick: str | Column | float, eps: float = 1e-6) -> Column:
    """Whether a price is a whole number of ticks within a tolerance."""
    t = F.lit(tick) if isinstance(tick, int | float) else col(tick)
    q = col(c) / t
    return F.abs(q - F.round(q)) < F.lit(eps)


def in_bounds(lat: str | Column, lon: str | Column, box: tuple[float, float, float, float]) -> Column:
    """Inside a (lat_min, lat_max, lon_min, lon_max) domain, edges included."""
    return col(lat).between(box[0], box[1]) & col(lon).between(box[2], box[3])


# ------------------------------------------------------------------ positions


def position(score: str | Column, threshold: str | Column | float) -> Column:
    """+1 above the threshold, -1 below its negative, else 0."""
    t = F.lit(threshold) if isinstance(threshold, int | float) else col(threshold)
    s = col(score)
    return F.when(s > t, 1).when(s < -t, -1).when(s.isNotNull(), 0)


def action(pos: str | Column) -> Column:
    """Position to the order it stands for."""
    p = col(pos)
    return F.when(p > 0, "BUY").when(p < 0, "SELL").otherwise("HOLD")


def legs(pos: str | Column) -> Column:
    """Both sides of a two-leg order as (leg, side) structs; HOLD has none."""
    p = col(pos)

    def pair(first: str, second: str) -> Column:
        return F.array(
            F.struct(F.lit("near").alias("leg"), F.lit(first).alias("side")),
            F.struct(F.lit("far").alias("leg"), F.lit(second).alias("side")),
        )

    return F.when(p > 0, pair("BUY", "SELL")).when(p < 0, pair("SELL", "BUY")).otherwise(
        F.array().cast("array<struct<leg:string,side:string>>")
    )


def contract_parts(code: str | Column, root: str, months: str) -> Column:
    """root + listed month letter + two-digit year -> struct(ok, month, year)."""
    pat = f"^({root})([A-Z])([0-9]{{2}})$"
    m = F.regexp_extract(col(code), pat, 2)
    y = F.regexp_extract(col(code), pat, 3)
    ok = (m != "") & F.lit(months).contains(m)
    return F.struct(
        ok.alias("ok"),
        F.when(ok, m).alias("month_letter"),
        F.when(ok, F.lit(2000) + y.try_cast("int")).alias("delivery_year"),
    )


def normal_two_sided_p(z: Column) -> Column:
    """2*(1 - Phi(|z|)) by the Abramowitz-Stegun 7.1.26 rational erf (error < 1.5e-7)."""
    # Published coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + F.lit(k)) * t
    return poly * F.exp(-x * x)
