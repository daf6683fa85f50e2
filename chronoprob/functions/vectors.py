"""Column functions on feature rows (``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .probability import bound


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(x: Column, kind: str) -> Column:
    magnitudes = F.transform(x, lambda v: F.abs(v))
    if kind == "l1":
        return _sum(magnitudes)
    if kind == "l2":
        return F.sqrt(_sum(F.transform(x, lambda v: v * v)))
    if kind in ("linf", "maxabs"):
        return F.array_max(magnitudes)
    raise ValueError(f"no such norm: {kind}")


def row_normalized(x: Column, kind: str, eps: float = 1e-12, center: bool = False) -> Column:
    """x over max(norm, eps), after subtracting the row's mean where ``center``."""
    mean = lambda a: _sum(a) / F.size(a)
    base = bound(x, lambda a: bound(mean(a), lambda m: F.transform(a, lambda v: v - m))) if center else x
    return bound(base, lambda a: bound(F.greatest(norm(a, kind), F.lit(eps)), lambda n: F.transform(a, lambda v: v / n)))


def signed_log(x: Column, scale: float = 1.0) -> Column:
    return F.transform(x, lambda v: F.signum(v) * F.log1p(F.abs(v) / F.lit(scale)))


def signed_power(x: Column, power: float = 0.5) -> Column:
    return F.transform(x, lambda v: F.signum(v) * F.pow(F.abs(v), F.lit(power)))


def polynomial(x: Column, degree_two: bool = True, max_interactions: int = 4, bias: bool = False) -> Column:
    """The row, its squares and the first ``max_interactions`` products of pairs in row order."""
    parts = [F.array(F.lit(1.0))] if bias else []
    parts.append(x)
    if degree_two:
        parts.append(F.transform(x, lambda v: v * v))
    if max_interactions:
        pairs = F.flatten(F.transform(x, lambda v, i: F.transform(F.filter(x, lambda w, j: j > i), lambda w: v * w)))
        parts.append(F.slice(pairs, 1, max_interactions))
    return F.concat(*parts)


def rolled(x: Column, shift: int, mode: str = "wrap", fill: float = 0.0) -> Column:
    """The row shifted to the right by ``shift``; places left open wrap around or get ``fill``."""
    n = F.size(x)
    if mode == "wrap":
        k = F.pmod(F.lit(shift), n)
        return F.concat(F.slice(x, n - k + 1, F.when(k == 0, 0).otherwise(k)) if shift else F.slice(x, 1, 0), F.slice(x, F.lit(1), n - k))
    return F.transform(x, lambda v, i: F.coalesce(F.get(x, (i - shift).cast("int")), F.lit(fill)) if shift <= 0 else F.when(i >= shift, F.get(x, (i - shift).cast("int"))).otherwise(fill))


def masked(x: Column, keep, fill: float = 0.0) -> Column:
    """Entries where ``keep(index)`` holds, else ``fill``."""
    return F.transform(x, lambda v, i: F.when(keep(i), v).otherwise(fill))


def circular_mean(phase: Column) -> Column:
    """Aggregate: mean direction of angles."""
    return F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase)))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def md5_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of parts joined by ``:``; a seeded draw that any engine can repeat."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
