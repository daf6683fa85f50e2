"""N-gram Jaccard self-join by chosen paths.

A text is the set of its word shingles (five words; a shorter text is one shingle of all its words).
Equal sets are one set with copies. Each set is embedded as ``hashes`` minimum hashes, of which two sets
share a part near their Jaccard similarity. The join splits all sets on sampled tokens of that embedding:
at a node of a run, a few places are drawn from the node's name among those that its path has not used, and
a set goes to one child for each place, named after its token there, so that only sets that share the token
meet again. Buckets of one set are dropped, small ones are compared by brute force, larger ones are split
further, as deep as it takes. Only a bucket of sets that are mostly alike, where one child would keep more than
``dense`` of them, is compared as it is: its pairs are near ones, which the number of links counts, and no
split parts them. Large buckets are compared in blocks of bounded size, each block with each; a block meets
another as a whole, so that rows are blocks, not pairs. Nothing is capped.

Runs repeat, from other places, until the target recall: a pair at similarity s that meets at a node whose
children it shares with probability s each, and is then found below with probability f, is found there with
probability 1 - (1 - s f)^places. Splitting deeper and deeper, f falls to a fixed point, at which ``missed``
counts the pairs that no run finds; the number of runs is the least with which at most 1 - ``recall`` of the
pairs at the threshold are missed.

Pairs whose embeddings are far apart are left out (at 64 hashes and the margin used, a pair at the
threshold is left out once in some 10^5 cases); the others are verified exactly on their whole shingle
sets. A pair is verified in one bucket only, the first by name that both sets are in. What leaves a task is
sets, never pairs: which sets have partners, then their numbers of links and the first set that each is
linked to within the task; connected components come from alternating large-star and small-star steps.
Joins on sets and buckets leave hot keys (a text copied very often, a very large class) to Spark's adaptive
skew join; sums by the same keys are added up before the shuffle.

Shingles are compared by 64-bit hashes of their words; sets are identified by 128-bit hashes.

Defined cases: a text without words (null, empty, white space) is in no group, its class is its own id
and it has no links; exact copies share a class and have equal numbers of links, which count different
sets, not copies; a class is named by the least document id in it; documents with a null id take part and
do not name a class unless all are null; repeated rows are copies; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, cut, free_name

#: Words remembered within a task; beyond it the memory starts anew.
REMEMBERED = 200_000
_SEEDS = np.random.default_rng(20_240_229)
_PLACES = _SEEDS.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _SEEDS.integers(0, 2**63, 256, dtype=np.uint64)
_FACTORS = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = re.compile(WORD)
_ODD_ASCII = re.compile(r"[\x1c-\x1f]")  # white space to Python's split, but part of a word here
_word_hashes: dict[str, int] = {}


@dataclass(frozen=True)
class Join:
    words: int = 5
    similarity: float = 0.8
    hashes: int = 64
    #: Share of equal hashes from which a pair is verified.
    verify_from: float = 0.56
    #: Share of the pairs at the threshold that the splitting finds at least, however deep it goes.
    recall: float = 0.99999
    #: Places drawn at each node, the roots included.
    places: int = 2
    #: Buckets up to this size are compared by brute force.
    small: int = 64
    #: A bucket is not split if a child would keep more than this share of its sets.
    dense: float = 0.7
    #: Sets and bytes of shingles of a larger bucket that meet in one task: two blocks of about this size.
    block: int = 1024
    block_bytes: int = 32 << 20

    @property
    def runs(self) -> int:
        one = missed(self, self.similarity, 1)
        return next(r for r in range(1, self.hashes // self.places + 1) if one**r <= 1 - self.recall)


def missed(how: Join, similarity: float, runs: int | None = None) -> float:
    """The part of pairs at ``similarity`` that meet in no compared bucket, however deep buckets are split."""
    found, before = 1.0, 2.0
    while before - found > 1e-12:
        found, before = 1 - (1 - similarity * found) ** how.places, found
    return (1 - found) ** (how.runs if runs is None else runs)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``text``."""
    import xxhash

    w = text.split() if text.isascii() and not _ODD_ASCII.search(text) else _WORDS.findall(text)
    known = _word_hashes
    if len(known) >= REMEMBERED:
        known.clear()
    hashes = []
    for x in w:
        v = known.get(x)
        if v is None:
            v = known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
        hashes.append(v)
    if not hashes:
        return np.zeros(0, dtype=np.uint64)
    a = np.array(hashes, dtype=np.uint64)
    if len(a) < n:
        return _mixed(np.array([len(a)], dtype=np.uint64) + sum((a[k : k + 1] * _PLACES[k] for k in range(len(a))), np.zeros(1, dtype=np.uint64)))
    return np.unique(_mixed(sum((a[k : len(a) - n + 1 + k] * _PLACES[k] for k in range(n)), np.zeros(len(a) - n + 1, dtype=np.uint64))))


def sketch(h: np.ndarray, hashes: int) -> bytes:
    """The minimum hashes of a set, 32 bits each."""
    best = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    masks, factors = _MASKS[:hashes, None], _FACTORS[:hashes, None]
    for at in range(0, len(h), 1024):
        np.minimum(best, ((h[None, at : at + 1024] ^ masks) * factors).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4").tobytes()


def fingerprints(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, mark, n, sid, sk): size, identifier and embedding of each document's set; null without words."""

    @F.pandas_udf("n int, sid binary, sk binary")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch:
                h = shingles(text or "", how.words)
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), sketch(h, how.hashes)) if len(h) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "sid", "sk"])
        _word_hashes.clear()

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), printed("text").alias("p")).select("doc_id", "mark", "p.*")


def _token(place: Column) -> Column:
    return F.substring(F.col("sk"), (place * 4 + 1).cast("int"), F.lit(4))


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets of two sets or more, with their numbers of sets and of shingles."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    return cut(rows.join(sizes, "bucket"), "join-buckets")


def _buckets(sets: DataFrame, how: Join) -> DataFrame:
    """(sid, n, bucket, size, shingles): the buckets that are compared, of two sets or more."""
    root = lambda r, q: F.struct(F.xxhash64(F.lit(r), F.lit(q), _token(F.lit(q))).alias("bucket"), F.lit(1 << q).cast("long").alias("used"))
    roots = F.array(*[root(r, r * how.places + j) for r in range(how.runs) for j in range(how.places)])
    rows = _sized(sets.select("sid", "n", F.explode(roots).alias("r")).select("sid", "n", "r.*"))
    # places in an order of the node's own (an odd step visits all), without those that its path has used
    first, step = F.xxhash64("bucket", F.lit(0)), F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(how.hashes // 2)) * 2 + 1
    order = F.transform(F.sequence(F.lit(0), F.lit(how.hashes - 1)), lambda k: F.pmod(F.pmod(first, F.lit(how.hashes)) + step * k, F.lit(how.hashes)))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int"))
    drawn = F.slice(F.filter(order, lambda p: bit(p).bitwiseAND(F.col("used")) == 0), 1, how.places)
    child = lambda p: F.struct(F.xxhash64("bucket", p, _token(p)).alias("bucket"), F.col("used").bitwiseOR(bit(p)).alias("used"))
    done: DataFrame | None = None
    while True:
        stop = (F.col("size") <= how.small) | (F.bit_count("used") > how.hashes - how.places)
        ended, rest = rows.where(stop), rows.where(~stop)
        more = not rest.isEmpty()
        if more:
            parent = rest.join(sets.select("sid", "sk"), "sid").select("sid", "n", F.col("bucket").alias("parent"), F.col("size").alias("parent_size"), F.explode(F.transform(drawn, child)).alias("c"))
            children = _sized(parent.select("sid", "n", "parent", "parent_size", "c.*"))
            alike = cut(children.where(F.col("size") > how.dense * F.col("parent_size")).select("parent").distinct(), "join-alike")
            ended = ended.unionByName(rest.join(alike, F.col("bucket") == F.col("parent"), "left_semi"))
            rows = children.join(alike, "parent", "left_anti").drop("parent", "parent_size")
        ended = ended.select("sid", "n", "bucket", "size", "shingles")
        done = ended if done is None else done.unionByName(ended)
        if not more:
            return done


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of rows with equal keys, across batches."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        k = pdf[keys].to_numpy(dtype=np.int64)
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()]
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for a, b in zip(starts, starts[1:]):
            yield {c: v[a:b] for c, v in columns.items()}
        rest = pdf.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


TASK = ["bucket", "low", "high"]


def _halves(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets of a task's two blocks; twice the same where a block meets itself."""
    every = np.arange(len(g["sid"]))
    if g["low"][0] == g["high"][0]:
        return every, every
    return every[g["own"] == g["low"][0]], every[g["own"] == g["high"][0]]


def _shared(owner: np.ndarray, values: np.ndarray, m: int, left: np.ndarray, right: np.ndarray, width: int = 512) -> np.ndarray:
    """How many values each set of ``left`` has in common with each of ``right``; ``owner`` has each value's set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # exact up to 2^24
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    several = counts[at] > 1
    owner, at = owner[several], at[several]
    if not len(at):
        return out
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, int(at[-1]) + 1, width):
        a, b = np.searchsorted(at, [start, start + width])
        dense = np.zeros((m, min(width, int(at[-1]) + 1 - start)), dtype=np.float32)
        dense[owner[a:b], at[a:b] - start] = 1
        out += dense[left] @ dense[right].T
    return out


def _near_pairs(g: dict[str, np.ndarray], how: Join) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, place, places in the right half) of sets whose embeddings are near and that have no bucket in
    common before this one."""
    m = len(g["sid"])
    s = np.frombuffer(b"".join(g["sk"]), dtype="<u4").reshape(m, -1)
    n = g["n"].astype(np.int64)
    left, right = _halves(g)
    inside = left is right
    s_right, n_right = s[right], n[right]
    met = None
    for row, i in enumerate(left.tolist()):
        start = row + 1 if inside else 0
        others = n_right[start:]
        near = np.minimum(others, n[i]) >= (how.similarity - 1e-9) * np.maximum(others, n[i])
        near &= (s_right[start:] == s[i]).sum(axis=1) >= how.verify_from * how.hashes
        at = np.flatnonzero(near) + start
        if not len(at):
            continue
        if met is None:
            names, owner = np.concatenate(g["buckets"]), np.repeat(np.arange(m), [len(b) for b in g["buckets"]])
            before = names < g["bucket"][0]
            met = _shared(owner[before], names[before], m, left, right) > 0
        at = at[~met[row, at]]
        if len(at):
            yield row, i, at


def candidates(sets: DataFrame, how: Join = Join()) -> DataFrame:
    """(bucket, low, high, own, sid, n, sk, buckets): the sets that have partners to be verified in a task."""
    members = _buckets(sets, how)
    lists = members.groupBy("sid").agg(F.collect_list("bucket").alias("buckets"))  # the leaves of a set's paths
    parts = F.greatest(F.ceil(F.col("size") / how.block), F.ceil(F.col("shingles") * 8 / how.block_bytes)).cast("int")
    rows = members.join(lists, "sid").join(sets.select("sid", "sk"), "sid").withColumn("parts", parts)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    held = ("sid", "n", "sk", "buckets")
    blocks = rows.groupBy("bucket", "own", "parts").agg(*[F.collect_list(c).alias(c) for c in held])  # a block is bounded
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select(*TASK, "own", *held)

    def partnered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for packed in _groups(batches, TASK):
            sizes = [len(x) for x in packed["sid"]]
            g = {k: np.repeat(packed[k], sizes) for k in (*TASK, "own")}
            for k in held:
                g[k] = np.concatenate(packed[k]) if k == "n" else np.array([None, *(x for part in packed[k] for x in part)], dtype=object)[1:]
            right = _halves(g)[1]
            at: set[int] = set()
            for _, i, others in _near_pairs(g, how):
                at.add(i)
                at.update(right[others].tolist())
            if at:
                keep = sorted(at)
                yield pd.DataFrame({k: v[keep] for k, v in g.items()})

    dealt = blocks.repartition(*TASK).sortWithinPartitions(*TASK)
    return dealt.mapInPandas(partnered, "bucket long, low int, high int, own int, sid binary, n int, sk binary, buckets array<long>")


def _links(g: dict[str, np.ndarray], how: Join) -> tuple[np.ndarray, np.ndarray]:
    """The number of links of each set of a task, and the place of the first set that each is linked to, at
    once or through others."""
    limit = Fraction(how.similarity).limit_denominator(10_000)
    sets = [np.frombuffer(x, dtype="<u8") for x in g["elements"]]
    m = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    left, right = _halves(g)
    pairs = list(_near_pairs(g, how))
    common = None
    if sum(len(at) for _, _, at in pairs) > 2 * m:
        common = _shared(np.repeat(np.arange(m), size), np.concatenate(sets), m, left, right)
    rank = np.argsort(np.argsort(np.array([None, *g["sid"]], dtype=object)[1:], kind="stable"))
    count, label = np.zeros(m, dtype=np.int64), rank.copy()
    for row, i, at in pairs:
        js = right[at]
        both = common[row, at].astype(np.int64) if common is not None else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js])
        js = js[both * limit.denominator >= limit.numerator * (size[i] + size[js] - both)]
        if len(js):
            count[i] += len(js)
            count[js] += 1
            merged = np.unique(label[[i, *js]])
            if len(merged) > 1:
                label[np.isin(label, merged)] = merged[0]
    return count, np.argsort(rank)[label]


def verify(wanted: DataFrame, elements: DataFrame, how: Join = Join()) -> DataFrame:
    """(sid, n_links, root): links found in each task, and the first of the sets that they connect."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, TASK):
            count, first = _links(g, how)
            at = np.flatnonzero(count)
            if len(at):
                yield pd.DataFrame({"sid": g["sid"][at], "n_links": count[at], "root": g["sid"][first[at]]})

    rows = wanted.join(elements, "sid").repartition(*TASK).sortWithinPartitions(*TASK)
    return rows.mapInPandas(links, "sid binary, n_links long, root binary")


def _elements(docs: DataFrame, ids: DataFrame, how: Join) -> DataFrame:
    """(sid, elements) of the sets whose first document ``ids`` names."""

    @F.pandas_udf("sid binary, elements binary")
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            found = [shingles(x or "", how.words) for x in batch]
            yield pd.DataFrame({"sid": [xxhash.xxh3_128_digest(h.tobytes()) for h in found], "elements": [h.astype("<u8").tobytes() for h in found]})
        _word_hashes.clear()

    # else the optimizer would move the check that sid is not null, and with it this function, below the join
    again = again.asNondeterministic()
    ids = ids.select("first_id", "first_mark").distinct()
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_mark")), "left_semi")
    return some.select(again("text").alias("e")).select("e.*").dropDuplicates(["sid"])


def components(edges: DataFrame, a: str = "sid", b: str = "root") -> DataFrame:
    """(node, first): the least node of each node's connected component, by alternating star steps.

    Each round is cut, and rounds go on until every node but the first points at the first."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "components")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        e = cut(small, "components")
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u", "left_semi")
        if inner.isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            break
    firsts = e.select(F.col("v").alias("node"), F.col("v").alias("first")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("first")).unionByName(firsts)


def classes(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, mark, sid, class_id, class_first, copy_of, n_links) of each document; see the module's text.

    ``mark`` is the 64-bit hash of the text, and (``class_first``, ``class_mark``) names the class's first document."""
    prints = cut(fingerprints(docs, how), "join-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    sets = prints.where("sid is not null").groupBy("sid").agg(first, F.any_value("n").alias("n"), F.any_value("sk").alias("sk"))
    sets = cut(sets.select("sid", "n", "sk", "first"), "join-sets")
    wanted = cut(candidates(sets, how), "join-candidates")
    ids = sets.join(wanted.select("sid").distinct(), "sid", "left_semi").select(F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"))
    found = cut(verify(wanted, _elements(docs, ids, how), how), "join-links")
    linked = found.groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    stars = components(found.select("sid", "root"))
    per = sets.select("sid", "first").join(linked, "sid", "left").join(stars.withColumnRenamed("node", "sid").withColumnRenamed("first", "star"), "sid", "left")
    per = per.withColumn("star", F.coalesce("star", "sid"))
    named = per.groupBy("star").agg(F.min("first").alias("class_first"))
    per = per.join(named, "star").select("sid", F.col("first").alias("copy_first"), "class_first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = prints.select("doc_id", "mark", "sid").join(per, "sid", "left")
    return out.select(
        "doc_id", "mark", "sid", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_first.doc_id")).alias("class_id"), "class_first",
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("copy_first.doc_id")).alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def link_counts(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, class_id, n_links, copy_of: one row for each document."""
    return classes(docs, how).select("doc_id", "class_id", "n_links", "copy_of")


def keep_first(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """One document of each class, the first; texts without words are in no class and all stay."""
    first, mark, own = free_name(docs, "class_first"), free_name(docs, "class_mark"), free_name(docs, "text_mark")
    found = classes(docs, how)
    firsts = found.where("sid is not null").select(F.col("class_first.doc_id").alias(first), F.col("class_first.mark").alias(mark)).distinct()
    worded = F.coalesce(F.col("text").rlike(rf"[^{SPACE_CLASS}]"), F.lit(False))
    some = docs.where(worded).withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(first)) & (F.col(own) == F.col(mark))
    kept = some.join(firsts, same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)
    return kept.unionByName(docs.where(~worded))
