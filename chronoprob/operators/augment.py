"""Augmentation and weighting of source rows; draws are hashes of a seed and the row, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoprob.functions.vectors import dot, md5_unit, norm, squared_distance

from .features import arrays, class_means, column_scales, mean_and_covariance, positions, with_stats
from .ranks import placed, quantiles
from .sequences import begins, matrix


def partners(df: DataFrame, by: Sequence[str], row: str, copies: int, seed: int) -> DataFrame:
    """(row, copy, partner_x): for each copy another row of the same class, drawn by rank: rows of a class
    are numbered and the partner's number is hashed, so the join is on class and number."""
    w = Window.partitionBy(*by)
    numbered = df.select(*by, row, "x", (F.row_number().over(w.orderBy(row)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    wanted = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("_j", F.floor(md5_unit(F.lit(seed), F.col(row), F.col("copy")) * F.col("_n")).cast("int"))
    other = numbered.select(*by, F.col("_i").alias("_j"), F.col("x").alias("partner_x"))
    return wanted.join(other, [*by, "_j"]).select(*by, row, "copy", "x", "partner_x")


def mixed_up(df: DataFrame, by: Sequence[str] = ("label",), row: str = "row_id", copies: int = 1, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Synthetic rows lam x + (1 - lam) partner with lam uniform in [low, high]."""
    p = partners(df, by, row, copies, seed)
    lam = F.lit(low) + md5_unit(F.lit(f"{seed}-lam"), F.col(row), F.col("copy")) * F.lit(high - low)
    p = p.withColumn("lam", lam)
    return p.withColumn("x", F.transform(F.arrays_zip("x", "partner_x"), lambda t: F.col("lam") * t["x"] + (1 - F.col("lam")) * t["partner_x"])).drop("partner_x")


def perturbed(df: DataFrame, kind: str, amount: float, row: str = "row_id", copies: int = 1, seed: int = 0) -> DataFrame:
    """Copies with jitter (uniform noise of +-amount), masking (entries set to 0 with probability amount) or
    scaling (one factor in 1 +- amount for each copy)."""
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    u = lambda i: md5_unit(F.lit(f"{seed}-{kind}"), F.col(row), F.col("copy"), i)
    each = {
        "jitter": lambda v, i: v + (u(i) * 2 - 1) * F.lit(amount),
        "mask": lambda v, i: F.when(u(i) < amount, 0.0).otherwise(v),
        "scale": lambda v, i: v * (1 + (u(F.lit(0)) * 2 - 1) * F.lit(amount)),
    }[kind]
    return rows.withColumn("x", F.transform("x", each))


def mixstyle(df: DataFrame, lam: float, domain: str = "domain") -> DataFrame:
    """Rows whose domain statistics are mixed with those of the next domain in order."""
    stats = positions(df).groupBy(domain, "pos").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-12)).alias("s"))
    a = arrays(stats, ["m", "s"], [domain])
    order = Window.orderBy(domain)
    pairs = a.withColumn("_next", F.coalesce(F.lead(domain).over(order), F.first(domain).over(order)))
    other = a.select(F.col(domain).alias("_next"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    table = pairs.join(other, "_next").drop("_next")
    out = df.join(table, domain)
    z = F.transform(F.arrays_zip("x", "m", "s", "m2", "s2"), lambda t: (t["x"] - t["m"]) / t["s"] * (lam * t["s"] + (1 - lam) * t["s2"]) + lam * t["m"] + (1 - lam) * t["m2"])
    return out.withColumn("x", z).drop("m", "s", "m2", "s2")


def gaussian_rows(df: DataFrame, per_class: int, label: str = "label", shrinkage: float = 0.1, seed: int = 0) -> DataFrame:
    """``per_class`` rows drawn from each class's normal distribution with shrunken covariance: moments come
    from the rows, one small factor for each class goes to the tasks that draw."""
    from .features import moments

    m = moments(df, [label])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                s, n = np.asarray(r.s), r.n
                cov = (np.asarray(r.xx).reshape(len(s), len(s)) - np.outer(s, s) / n) / max(1, n - 1)
                cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / len(s) * np.eye(len(s))
                values, vectors = np.linalg.eigh(cov)
                z = np.random.default_rng([seed, r.part, int(r.code)]).normal(size=(r.draws, len(s)))
                x = s / n + z @ (vectors * np.sqrt(np.maximum(values, 0))).T
                yield pd.DataFrame({label: [getattr(r, label)] * len(x), "x": list(x)})

    step = 1000
    parts = m.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((per_class - 1) // step)))).withColumn("draws", F.least(F.lit(step), F.lit(per_class) - F.col("part") * step).cast("int"))
    coded = parts.withColumn("code", F.pmod(F.xxhash64(label), F.lit(2**31)).cast("long"))
    return coded.mapInPandas(draw, f"{label} {dict(df.dtypes)[label]}, x array<double>")


def rebalanced(df: DataFrame, label: str, row: str, target: str = "min", seed: int = 0) -> DataFrame:
    """Classes cut to, or repeated up to, the least or largest class's size, in seeded order."""
    counts = df.groupBy(label).agg(F.count("*").alias("c")).agg((F.min("c") if target == "min" else F.max("c")).alias("_goal"))
    drawn = placed(df.withColumn("_u", md5_unit(F.lit(seed), F.col(row))), F.col("_u"), ["_u", row], [label], "_r", "_n")
    ranked = drawn.drop("_u").join(F.broadcast(counts))  # one row
    if target == "min":
        return ranked.where(F.col("_r") <= F.col("_goal")).drop("_r", "_n", "_goal")
    times = F.floor((F.col("_goal") - F.col("_r")) / F.col("_n")) + 1
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_r", "_n", "_goal")


def bags(df: DataFrame, n: int, row: str, seed: int = 0) -> DataFrame:
    """(bag, weight) for each row: Poisson(1) weights by a hash, the resampling that needs no row's place."""
    u = md5_unit(F.lit(seed), F.col("bag"), F.col(row))
    cumulative, p, total = [], float(np.exp(-1)), 0.0
    for k in range(8):
        total += p
        cumulative.append(total)
        p /= k + 1
    weight = F.lit(len(cumulative))
    for k in reversed(range(len(cumulative))):
        weight = F.when(u < cumulative[k], k).otherwise(weight)
    return df.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("weight", weight).where("weight > 0")


def mean_one(df: DataFrame, weight: Column) -> DataFrame:
    """``weight`` over its mean, a partial aggregate that goes to the rows as one row."""
    weighed = df.withColumn("_w", weight)
    return weighed.join(F.broadcast(weighed.agg(F.avg("_w").alias("_mean")))).withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean")


def scaled_distances(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """``df`` with the distance of each row to its group's mean, in units of the columns' deviations."""
    out = with_stats(df, column_scales(df, "none", "std"), ["scale"])
    means = class_means(df, list(group))
    out = out.join(means, list(group))
    scaled = lambda c: F.transform(F.arrays_zip(c, "scale"), lambda t: t[c] / t["scale"])
    return out.withColumn("distance", F.sqrt(squared_distance(scaled("x"), scaled("mean")))).drop("mean", "scale")


def outlier_weights(df: DataFrame, label: str = "label", multiplier: float = 3.0, soft: bool = False) -> DataFrame:
    """Weight 1 within median + multiplier * MAD of the class's distances, else 0 (or cut / distance).

    Distances are a table: means are sums whose last bits depend on the order of the rows, and all uses have to see
    the same numbers."""
    from chronoprob.sources.observations import cut

    d = cut(scaled_distances(df, [label]), "distances")
    middle = lambda v, to: quantiles(d.select(F.col(label).alias("pos"), v.alias("v")), [0.5]).select(F.col("pos").alias(label), F.get("q", F.lit(0)).alias(to))
    d = d.join(middle(F.col("distance"), "_m"), label)
    d = d.join(middle(F.abs(F.col("distance") - F.col("_m")), "_mad"), label).withColumn("_mad", 1.4826 * F.col("_mad"))
    limit = F.col("_m") + multiplier * F.col("_mad")
    return d.withColumn("weight", F.when(F.col("distance") <= limit, 1.0).otherwise(limit / F.col("distance") if soft else 0.0)).drop("_m", "_mad")


def distance_weights(df: DataFrame, group: Sequence[str], temperature: float = 1.0, floor: float = 1e-3) -> DataFrame:
    """exp(-d^2 / (features * temperature)), floored, with mean one."""
    d = scaled_distances(df, group)
    return mean_one(d, F.greatest(F.exp(-F.col("distance") * F.col("distance") / F.size("x") / temperature), F.lit(floor)))


def confidence_weights(df: DataFrame, mode: str, label: str = "true_label") -> DataFrame:
    """Weights with mean one: confidence, correct_confidence, margin or 1 - relative entropy."""
    from chronoprob.functions import probability as P

    p = F.col("p")
    w = {"confidence": P.confidence(p), "correct_confidence": P.true_probability(p, F.col(label)), "margin": P.margin(p), "entropy": 1 - P.entropy(p, True)}[mode]
    return mean_one(df, w)


def domain_importance(df: DataFrame, floor: float = 0.05, ceiling: float = 20.0) -> DataFrame:
    """Weights of source rows from a classifier of source against target: the odds of target, clipped, with
    mean one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("features", array_to_vector("x")).withColumn("_y", (F.col("role") == "target").cast("double"))
    model = LogisticRegression(labelCol="_y", maxIter=50, regParam=1e-3).fit(rows)
    p = F.get(vector_to_array("probability"), F.lit(1))
    out = model.transform(rows.where("role = 'source'"))
    odds = F.least(F.lit(ceiling), F.greatest(F.lit(floor), p / (1 - p)))
    return mean_one(out.drop("rawPrediction", "prediction"), odds).drop("features", "probability", "_y")


def _meeting(df: DataFrame, block: int) -> DataFrame:
    """Rows (row_id, g, x) dealt so that each two meet once in ``_meetings``: to an odd number of shares, of ``block`` rows or
    more and at most two for each core. A task holds one share at a time, and the rows of the half of the shares before it pass in small batches; what is
    shuffled grows with the rows, while the work is that of all pairs."""
    from chronoprob.sources.observations import cut

    shares = min(2 * df.sparkSession.sparkContext.defaultParallelism - 1, -(-df.count() // block) | 1)
    rows = cut(df.select("g", "x", F.pmod(F.xxhash64("row_id"), F.lit(shares)).alias("home")), "meeting-rows")
    on = F.explode(F.sequence(F.lit(0), F.lit(shares // 2))).alias("on")
    pairs = rows.select("g", "x", "home", on).select("g", "x", F.pmod(F.col("home") + F.col("on"), F.lit(shares)).alias("b"), F.least("on", F.lit(1)).alias("kind"))
    return pairs.repartition(shares, "b").sortWithinPartitions("b", "kind")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Rows and their groups, those of the share that they pass, and whether they are its own."""
    share, held, own = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        starts = begins(table, ["b", "kind"]).tolist()
        for i, j in zip(starts, [*starts[1:], table.num_rows]):
            piece = table.slice(i, j - i)
            b, kind, x, g = piece["b"][0].as_py(), piece["kind"][0].as_py(), matrix(piece["x"]), piece["g"].to_numpy()
            if held and (b != share or kind):
                own, held = tuple(map(np.concatenate, zip(*held))), []
                yield *own, *own, True
            if b != share:
                share, own = b, None
            if not kind:
                held.append((x, g))
            elif own is not None:
                yield x, g, *own, False
    if held:
        own = tuple(map(np.concatenate, zip(*held)))
        yield *own, *own, True


#: Into how many parts a pass over all pairs divides the range of the median, and how many pairs a share draws to guess it.
PARTS, DRAWN = 1 << 17, 1 << 20


def _factors(x: np.ndarray, center: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their squared norms about ``center``, these norms, and two matrices: the first of some rows times
    the second of others is the squared distances, but for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        c = x - center
        norms = (c * c).sum(1)
    order = np.argsort(norms)
    c, norms, one = c[order], norms[order], np.ones((len(x), 1))
    kind = np.float32 if single and not (norms >= 1e30).any() else np.float64
    return x[order], norms, np.hstack([-2 * c, norms[:, None], one]).astype(kind), np.hstack([c, one, norms[:, None]]).astype(kind)


def _tiles(norms: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Stretches of at most ``size`` of the ordered ``norms``, of which those above the middle one are within a factor of four."""
    edges = [0]
    while (at := edges[-1]) < len(norms):
        near = int(np.searchsorted(norms, 4 * max(norms[at], norms[len(norms) // 2]), "right"))
        edges.append(max(at + 1, min(at + size, near, len(norms))))
    return list(zip(edges, edges[1:]))


def _compared(u: tuple, v: tuple, own: bool, low: float, high: float, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of the pairs of rows of ``u`` and ``v`` (``_factors``), tile by tile: how many are above ``least`` but below ``low``,
    how many above ``high``, and the squared distances of the others, and of some more. Products decide where rounding
    leaves no doubt; all else is measured exactly. Rows come in order of their norms, so that a far row blurs its own tile only."""
    x, nx, left, _ = u
    y, ny, _, right = v
    # the rounding errors are at most 2 (columns + 10) units for each side's norm, a unit being half an epsilon
    eps = 4 * (x.shape[1] + 16) * max(np.finfo(left.dtype).eps, np.finfo(right.dtype).eps)
    tiny = 4 * (x.shape[1] + 2) * float(np.finfo(np.float32).tiny)

    def exact(which: np.ndarray, at: int, to: int) -> Iterator[np.ndarray]:
        where = np.flatnonzero(which)
        for k in range(0, len(where), 1 << 10):
            i, j = np.divmod(where[k : k + (1 << 10)], which.shape[1])
            with np.errstate(over="ignore", invalid="ignore"):
                d = y[to:].take(j, axis=0)
                d -= x[at:].take(i, axis=0)
                d *= d
                found = d.sum(axis=1)
            yield found

    space = np.empty(1 << 18, dtype=np.result_type(left, right))
    for (at, end), (to, till) in product(_tiles(nx, 256), _tiles(ny, 1024)):
        if not own or at < till - 1:
            blur = float(eps * (nx[at:end].max() + ny[to:till].max()) + tiny)
            with np.errstate(over="ignore", invalid="ignore"):
                rough = np.matmul(left[at:end], right[to:till].T, out=space[: (end - at) * (till - to)].reshape(end - at, -1))
                under, over = rough < low - blur, rough > high + blur
            if own and to < end:
                pair = np.arange(to, till) > np.arange(at, end)[:, None]
                under &= pair
                over &= pair
            else:
                pair = None
            below, above = np.count_nonzero(under), np.count_nonzero(over)
            if below and not rough.min() > least + blur:
                below -= sum(np.count_nonzero(~(d > least)) for d in exact(under & ~(rough > least + blur), at, to))
            yield below, above, np.zeros(0)
            doubt = ~(under | over)
            for d in exact(doubt if pair is None else doubt & pair, at, to):
                yield 0, 0, d


def median_squared_distance(df: DataFrame, least: float = 1e-12, block: int = 1024) -> float | None:
    """The exact median of the squared distances above ``least`` of all pairs of rows; None without such pairs.

    Rows meet as ``_meeting`` deals them. Pairs drawn inside the shares guess a range that holds the median. A pass over
    all pairs counts those below it and those in each of PARTS parts of it, in the order of a number's bits, with the least
    and largest of a part. It is the median's place in the counts that decides: the next pass takes the part that it falls
    in, or what lies beside the range if the guess was wrong, until it is the least or largest of a part. Two passes are
    usual; tasks send counts only."""
    meeting = _meeting(df.select("row_id", F.lit(0).alias("g"), "x"), block)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, v, _, _ in _meetings(batches):
            draw = np.random.default_rng(len(v))
            for _ in range(0, min(DRAWN, len(v) ** 2), 1 << 14):
                i, j = draw.integers(0, len(v), (2, 1 << 14))
                with np.errstate(over="ignore", invalid="ignore"):
                    d, size = ((v[i] - v[j]) ** 2).sum(axis=1), ((v[i] - v[0]) ** 2).sum(axis=1)
                some = np.isfinite(d) & np.isfinite(size) & (d > least)
                yield pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(size[some])], names=["d", "size"])

    guess = meeting.where("kind = 0").mapInArrow(drawn, "d double, size double")
    n = df.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("columns")).first()
    off = min(0.5, 3 * (0.5 / max(1, n["n"]) ** 0.5 + 0.5 / DRAWN**0.5))  # some three deviations of the place of the guess
    seen = guess.agg(F.percentile_approx("d", [0.5 - off, 0.5 + off], 10_000).alias("q"), F.avg("size").alias("size")).first()
    low, high = seen["q"] if seen["q"] else (float(np.nextafter(least, np.inf)), np.inf)
    # single precision where it leaves few pairs in doubt
    single = seen["size"] is not None and 16 * (n["columns"] + 16) * float(np.finfo(np.float32).eps) * seen["size"] * off < 0.01 * (high - low)
    bits = lambda x: np.asarray(x, dtype=np.float64).view(np.uint64)

    def counts(low: float, high: float) -> pa.Table:
        """(k, n, low, high): number, least and largest of the distances in each part of the range; part -1 is below it,
        PARTS above."""
        shift = max(0, int(bits(high) - bits(low)).bit_length() - PARTS.bit_length() + 1)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, first, last = np.zeros(PARTS, dtype=np.int64), np.full(PARTS, np.inf), np.zeros(PARTS)
            below = above = n = 0
            waiting: list[np.ndarray] = []
            held = right = center = None

            def count() -> tuple[int, int]:
                d = np.sort(np.concatenate(waiting))
                waiting.clear()
                d = d[d > least]
                a, b = np.searchsorted(d, low, "left"), np.searchsorted(d, high, "right")
                mine = d[a:b]
                if len(mine):
                    k = ((bits(mine) - bits(low)) >> np.uint64(shift)).astype(np.int64)
                    starts = np.flatnonzero(np.diff(k, prepend=-1))
                    ends, at = np.append(starts[1:], len(k)), k[starts]
                    number[at] += ends - starts
                    first[at], last[at] = np.minimum(first[at], mine[starts]), np.maximum(last[at], mine[ends - 1])
                return a, len(d) - b

            for u, _, v, _, own in _meetings(batches):
                if v is not held:
                    known = v[np.isfinite(v).all(axis=1)]
                    held, center = v, known.mean(axis=0) if len(known) else np.zeros(v.shape[1])
                    right = _factors(v, center, single)
                for lower, upper, d in _compared(right if own else _factors(u, center, single), right, own, low, high, least):
                    below, above, n = below + lower, above + upper, n + len(d)
                    if len(d):
                        waiting.append(d)
                    if n >= 1 << 20:
                        lower, upper = count()
                        below, above, n = below + lower, above + upper, 0
            if waiting:
                lower, upper = count()
                below, above = below + lower, above + upper
            k = np.flatnonzero(number)
            columns = [(-1, k, PARTS), (below, number[k], above), (0.0, first[k], 0.0), (0.0, last[k], 0.0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.hstack(c)) for c in columns], names=["k", "n", "low", "high"])

        found = meeting.mapInArrow(partial, "k long, n long, low double, high double").groupBy("k")
        return found.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("k").toArrow()

    known: dict[int, float] = {}
    while True:
        k, number, first, last = (c.to_numpy() for c in counts(low, high).columns)
        total = int(number.sum())
        if not total:
            return None
        upto, ends = np.cumsum(number), []
        for rank in {(total - 1) // 2, total // 2} - set(known):
            at = int(np.searchsorted(upto, rank, "right"))
            if k[at] == -1:
                ends += [max(float(np.nextafter(least, np.inf)), low - 8 * max(high - low, low / 1024)), float(np.nextafter(low, 0.0))]
            elif k[at] == PARTS:
                ends += [float(np.nextafter(high, np.inf)), high + 8 * max(high - low, high / 1024)]
            elif rank == upto[at] - number[at] or first[at] == last[at]:
                known[rank] = float(first[at])
            elif rank == upto[at] - 1:
                known[rank] = float(last[at])
            else:
                ends += [float(first[at]), float(last[at])]
        if not ends:
            return float(np.mean(list(known.values())))
        low, high = min(ends), max(ends)


def median_gamma(df: DataFrame) -> float:
    """One over twice the exact median of the positive squared distances of all pairs of rows (1/2 without)."""
    median = median_squared_distance(df)
    return 1.0 / (2.0 * (1.0 if median is None else median))


def kernel_mmd(df: DataFrame, gamma: float | None = None, domain: str = "domain", block: int = 1024) -> DataFrame:
    """(domain, mmd2): squared maximum mean discrepancy of each source domain to the target under a Gaussian
    kernel (of the exact ``median_gamma`` without ``gamma``), from the exact means of the kernel over all pairs of rows.

    Rows meet as ``_meeting`` deals them, those of a domain with one another and with the target's, and tasks send a sum for
    each domain, while the work is that of all pairs. ``mmd_estimates`` is the way for large domains."""
    from chronoprob.sources.observations import cut

    width = median_gamma(df) if gamma is None else gamma
    # the target's group is 0, a domain's its hash, which is odd
    group = F.when(F.col("t"), F.lit(0)).otherwise(F.xxhash64("d").bitwiseOR(F.lit(1))).cast("long").alias("g")
    rows = df.select(F.col(domain).alias("d"), (F.col("role") == "target").alias("t"), "row_id", "x").where("t is not null")
    counts = rows.select(F.when(~F.col("t"), F.col("d")).alias("d"), group).groupBy("g", "d").agg(F.count("*").alias("n"))

    def columns(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For each row of ``v`` the sum of the kernel over ``u``."""
        out, vv, step = np.zeros(len(v)), (v * v).sum(1), max(1, (1 << 20) // len(v))
        for at in range(0, len(u), step):
            a = u[at : at + step]
            d = np.maximum((a * a).sum(1)[:, None] + vv - 2 * a @ v.T, 0.0)
            out += np.exp(-width * d).sum(axis=0)
        return out

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, bool], float] = {}
        for u, gu, v, gv, own in _meetings(batches):
            for g in np.unique(gu).tolist():
                mine = (gv == g) | ((gv == 0) if g else not own)  # within a share a source's rows look for the target's
                if not mine.any():
                    continue
                s, other = columns(u[gu == g], v[mine]), gv[mine]
                for h in np.unique(other).tolist():
                    key = (g or h, g != h)
                    total[key] = total.get(key, 0.0) + (2.0 if g == h and not own else 1.0) * float(s[other == h].sum())
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(g, across, s) for (g, across), s in total.items()], columns=["g", "across", "s"]).astype({"g": "int64", "across": "bool", "s": "float64"}), preserve_index=False)

    found = _meeting(rows.select("row_id", group, "x"), block).mapInArrow(partial, "g long, across boolean, s double")
    sums = cut(found.groupBy("g", "across").agg(F.sum("s").alias("s")).join(counts, "g"), "kernel-sums")
    target = sums.where("g = 0").select(F.col("n").alias("nt"), (F.col("s") / F.col("n") / F.col("n")).alias("tt"))  # one row
    part = F.when(F.col("across"), -2 * F.col("s") / F.col("n") / F.col("nt")).otherwise(F.col("s") / F.col("n") / F.col("n"))
    per = sums.where("g <> 0").join(F.broadcast(target)).groupBy("d").agg((F.sum(part) + F.max("tt")).alias("m"))
    return per.select(F.col("d").alias(domain), F.greatest(F.lit(0.0), F.col("m")).alias("mmd2"))


def mmd_estimates(df: DataFrame, dim: int, gamma: float, k: int = 256, seed: int = 0, domain: str = "domain") -> DataFrame:
    """(domain, mmd2): squared distance of each source domain's mean random Fourier features to the target's,
    which estimates the squared maximum mean discrepancy without pairs of rows."""
    from .features import random_features

    z = random_features(df, dim, k, gamma, seed)
    own = class_means(z.where("role = 'source'").select(domain, "x"), [domain])
    target = class_means(z.where("role = 'target'").select("x"), []).withColumnRenamed("mean", "_t")
    return own.join(F.broadcast(target)).select(domain, F.greatest(F.lit(0.0), squared_distance(F.col("mean"), F.col("_t"))).alias("mmd2"))  # one row


def softmax_weights(scores: DataFrame, score: str, temperature: float = 1.0, top_k: int | None = None, blend: float = 1.0) -> DataFrame:
    """Weights of the domains: softmax of score / temperature over the best ``top_k``, times their number,
    blended with equal weights."""
    every = Window.partitionBy()
    ranked = scores.withColumn("_r", F.row_number().over(Window.orderBy(F.col(score).desc(), scores.columns[0])))
    keep = ranked if top_k is None else ranked.where(F.col("_r") <= top_k)
    e = F.exp((F.col(score) - F.max(score).over(every)) / temperature)
    n = F.count("*").over(every)
    return keep.withColumn("_e", e).withColumn("weight", blend * F.col("_e") / F.sum("_e").over(every) * n + (1 - blend)).drop("_e", "_r")


def domain_similarity(df: DataFrame, metric: str = "mean", domain: str = "domain") -> DataFrame:
    """(domain, score): minus the distance of a source domain's mean to the target's, or the cosine of the
    two after taking off the mean of all."""
    own = class_means(df.where("role = 'source'").select(domain, "x"), [domain])
    target = class_means(df.where("role = 'target'").select("x"), []).withColumnRenamed("mean", "_t")
    grand = class_means(df.select("x"), []).withColumnRenamed("mean", "_g")
    both = own.join(F.broadcast(target)).join(F.broadcast(grand))  # one row each
    if metric == "mean":
        return both.select(domain, (-F.sqrt(squared_distance(F.col("mean"), F.col("_t")))).alias("score"))
    a, b = F.zip_with("mean", "_g", lambda x, g: x - g), F.zip_with("_t", "_g", lambda x, g: x - g)
    return both.select(domain, (dot(a, b) / F.greatest(norm(a, "l2") * norm(b, "l2"), F.lit(1e-12))).alias("score"))


def covariance_distance(df: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, distance): Frobenius distance of each source domain's covariance to the target's, from
    moments by domain."""
    from .features import moments

    _, target, _ = mean_and_covariance(df.where("role = 'target'"))
    m = moments(df.where("role = 'source'"), [domain])

    @F.pandas_udf("double")
    def away(n: pd.Series, s: pd.Series, xx: pd.Series) -> pd.Series:
        out = []
        for c, a, b in zip(n, s, xx):
            a = np.asarray(a)
            cov = (np.asarray(b).reshape(len(a), len(a)) - np.outer(a, a) / c) / max(1, c - 1)
            out.append(float(np.linalg.norm(cov - target)))
        return pd.Series(out)

    return m.select(domain, away("n", "s", "xx").alias("distance"))


def transferability(df: DataFrame, domain: str = "domain", label: str = "label") -> DataFrame:
    """(domain, score): 1-norm of a source domain's between-class scatter over that of the scatter of its and
    the target's mean about the mean of both, from class means and counts."""
    src = df.where("role = 'source'")
    means = class_means(src.select(domain, label, "x"), [domain, label]).join(src.groupBy(domain, label).agg(F.count("*").alias("n")), [domain, label])
    other = df.where("role = 'target'")
    target, n_target = np.asarray(class_means(other.select("x"), []).first()["mean"]), other.count()
    types = dict(df.dtypes)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = np.stack(pdf["mean"].to_list()), pdf["n"].to_numpy(dtype=float)
        own = n @ m / n.sum()
        between = ((m - own).T * n) @ (m - own)
        away = n.sum() * n_target / (n.sum() + n_target) * np.outer(own - target, own - target)
        one = lambda a: np.abs(a).sum(axis=0).max()
        return pd.DataFrame([(pdf[domain].iloc[0], one(between) / (one(away) + 1e-12))], columns=[domain, "score"])

    return means.groupBy(domain).applyInPandas(score, f"{domain} {types[domain]}, score double")
