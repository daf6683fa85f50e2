r"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. The corpus then
says how strongly other words reveal them. With IC(e) = -log2 p(e) and PMI(t; e) = log2 p(t, e) / (p(t) p(e)),
IC(e) - PMI(t; e) = -log2 p(e | t) bits of an entity e are left to who reads the word ``t``. A word discloses where
few are left, by evidence and not by chance:

* it stands near mentions of e in ``support`` distinct texts and distinct contexts (the words around a mention) at
  least, so that one meeting by accident, or copies of one text, disclose nothing;
* p(e | t) is taken by its lower bound (Wilson's, ``errors`` standard errors; the distinct contexts, or texts if fewer,
  are the draws), and no more than ``generalise`` bits are left by it: then the word is generalised to the entity's
  kind, or removed where ``remove`` bits at most are left, wherever it stands in the corpus outside base spans;
* so many meetings would not come about if e were in the texts that hold t as often as in any (the binomial tail by
  Chernoff's bound, times the number of words near e, is at most ``chance``).

All counts are of distinct texts. Neither copies of texts nor the number of unrelated texts enter the bits that are
left; more unrelated texts can only make chance less likely.

Words are runs of letters in lower case that touch no base span: other addresses and numbers are no words. Work on
texts is row by row in Arrow batches; counts are Spark aggregations and joins, the same at every size. A word that
can disclose is in fewer than 2^``generalise`` texts for each text in which it meets the entity: words that are in
more texts near any entity, then words that are in more of one part in ``PART`` of the texts, are left out before the
texts with the others are listed, so what is shuffled grows with the evidence. Cells of hashes, of fixed number, tell
tasks which words are asked for; joins decide. The corpus is read three times, and a part of it once more.

Base patterns, leftmost and non-overlapping for each kind, matches that fail their check dropped without
another try: e-mail ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ip
``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` with parts of at most 255, card ``[0-9]([\x20-]?[0-9])+`` with
12 to 19 digits passing Luhn's check, phone ``\+[0-9][\x20().0-9-]+[0-9]`` with 9 to 15 digits. They run
in time linear in the text.

Defined cases: a null text is empty and has no spans; repeated rows get equal spans; spans that start
alike are ordered by kind as listed, added words last; words that overlap a base span are not added; an
empty table gives an empty result; other columns are kept by ``sanitise`` and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Fixed order of the kinds.
KINDS = ("email", "ip", "card", "phone")

# Possessive repeats and the look-behind find the same matches without trying again inside a run of digits.
_LOCAL = "[A-Za-z0-9._%+-]"
_LOCAL_END = re.compile(rf"{_LOCAL}+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


@dataclass(frozen=True)
class Disclosure:
    #: Words on either side of a mention that make its context.
    window: int = 8
    #: Distinct texts, and distinct contexts, in which word and entity have to meet.
    support: int = 2
    #: Standard errors of the lower bound; bits left of an entity up to which a word is generalised or removed.
    errors: float = 0.7
    generalise: float = 1.0
    remove: float = 0.25
    #: The most likely that meetings may be by chance, over all words near the entity.
    chance: float = 0.01


#: Cells of the filter of words, and the part of the texts that the first count reads.
CELLS, PART = 1 << 20, 16


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCALS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns by start, then kind."""
    found: list[tuple[int, int, int]] = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    found.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def _entity(kind: str, value: str) -> str:
    """A mention's entity: the value without case or separators."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(c for c in value if c in '0123456789')}"


def terms(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The words of ``text`` that touch none of its base spans."""
    at = iter([*spans, (len(text) + 1, 0, "")])
    start, stop, _ = next(at)
    ends = 0
    for m in _TERM.finditer(text):
        while start < m.end():
            ends = max(ends, stop)
            start, stop, _ = next(at)
        if m.start() >= ends:
            yield m


def _contexts(text: str, window: int) -> Iterator[tuple[str, str, list[str]]]:
    """(entity, digest of the context, its distinct words) of each mention."""
    spans = base_spans(text)
    every = list(terms(text, spans)) if spans else []
    starts, ends = [m.start() for m in every], [m.end() for m in every]
    for start, end, kind in spans:
        last, first = bisect_right(ends, start), bisect_left(starts, end)
        before = [m[0].lower() for m in every[max(0, last - window) : last]]
        after = [m[0].lower() for m in every[first : first + window]]
        digest = hashlib.sha256("\0".join([*before, "\1", *after]).encode("utf-8", "surrogatepass")).hexdigest()[:32]
        yield _entity(kind, text[start:end]), digest, sorted({*before, *after})


def contexts(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """(entity, context, mark, words): the distinct contexts of the entities in distinct texts."""
    window = how.window

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(e, c, k, w) for text, k in zip(pdf["text"], pdf["mark"]) if isinstance(text, str) for e, c, w in _contexts(text, window)]
            yield pd.DataFrame(found, columns=["entity", "context", "mark", "words"])

    marked = docs.select("text", F.xxhash64("text").alias("mark"))
    return marked.mapInPandas(rows, "entity string, context string, mark long, words array<string>").dropDuplicates(["entity", "context", "mark"])


def _places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mark, term, at): where words of ``wanted`` (term) stand in the distinct texts of ``docs`` (text, mark)."""
    cells = [r.cell for r in wanted.select((F.crc32(F.col("term").cast("binary")) % CELLS).cast("int").alias("cell")).distinct().collect()]  # CELLS at most
    on = bytearray(CELLS)
    for c in cells:
        on[c] = 1
    held = docs.sparkSession.sparkContext.broadcast(bytes(on))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        cells = held.value
        for pdf in batches:
            out = []
            for text, mark in _once(pdf):
                asked = {w for w in {x.lower() for x in set(_TERM.findall(text))} if cells[zlib.crc32(w.encode("utf-8", "surrogatepass")) % CELLS]}
                if not asked:
                    continue
                at: dict[str, list] = {}
                for m in terms(text, base_spans(text)):
                    if (w := m[0].lower()) in asked:
                        at.setdefault(w, []).append({"start": m.start(), "end": m.end()})
                out += [(mark, w, places) for w, places in at.items()]
            yield pd.DataFrame(out, columns=["mark", "term", "at"])

    found = docs.mapInPandas(rows, "mark long, term string, at array<struct<start:int,end:int>>")
    return found.join(wanted.select("term"), "term").dropDuplicates(["mark", "term"])


def _once(pdf: pd.DataFrame) -> Iterator[tuple[str, int]]:
    """(text, mark) of the distinct texts of a batch."""
    seen: set[int] = set()
    for text, mark in zip(pdf["text"], pdf["mark"]):
        if isinstance(text, str) and mark not in seen:
            seen.add(mark)
            yield text, mark


def _disclosed(docs: DataFrame, how: Disclosure) -> tuple[DataFrame, DataFrame]:
    """(term, kind, action, bits) of the words that disclose, and (mark, term, at) of those that might."""
    found = cut(contexts(docs, how), "pii-contexts")
    entities = found.groupBy("entity").agg(F.count_distinct("mark").alias("n_entity"))
    evidence = found.select("entity", "context", "mark", F.explode("words").alias("term"))
    pairs = cut(evidence.groupBy("entity", "term").agg(F.count_distinct("mark").alias("n_both"), F.count_distinct("context").alias("n_contexts")), "pii-pairs")
    tried = pairs.groupBy("entity").agg(F.count("*").alias("n_tried"))
    near = evidence.groupBy("term").agg(F.count_distinct("mark").alias("n_near"))
    marked = docs.where("text is not null").select("text", F.xxhash64("text").alias("mark"))
    n_texts = float(max(1, marked.select("mark").distinct().count()))

    def bits(n: Column) -> Column:
        """What is left of the entity for a word that ``n`` texts hold; null where the evidence may be chance."""
        draws_of = F.least("n_contexts", "n_both")
        p = F.least(F.lit(1.0), F.col("n_both") / n)
        draws, z2 = draws_of / p, how.errors**2
        lower = (p + z2 / (2 * draws) - how.errors * F.sqrt(p * (1 - p) / draws + z2 / (4 * draws * draws))) / (1 + z2 / draws)
        base = F.col("n_entity") / F.lit(n_texts)
        apart = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
        sure = (p > base) & (F.log("n_tried") - draws * apart <= F.log(F.lit(how.chance)))
        return F.when(sure, -F.log2(lower))

    pairs = pairs.where((F.col("n_both") >= how.support) & (F.col("n_contexts") >= how.support)).join(entities, "entity").join(tried, "entity").join(near, "term")
    # a word discloses most if it stands nowhere but near entities: others need not be counted
    pairs = cut(pairs.where(bits(F.col("n_near")) <= how.generalise), "pii-candidates")
    most = pairs.groupBy("term").agg((F.max("n_both") * 2.0**how.generalise).alias("most"))
    some = _places(marked.where(F.pmod("mark", F.lit(PART)) == 0), most).groupBy("term").agg(F.count("*").alias("n"))
    wanted = cut(most.join(some, "term", "left").where(F.coalesce("n", F.lit(0)) <= F.col("most")).select("term"), "pii-wanted")
    places = cut(_places(marked, wanted), "pii-places")
    counts = places.groupBy("term").agg(F.count("*").alias("n"))
    scored = pairs.join(counts, "term").withColumn("bits", bits(F.col("n"))).where(F.col("bits") <= how.generalise)
    best = scored.groupBy("term").agg(F.min(F.struct("bits", F.split("entity", ":")[0].alias("kind"))).alias("b"))
    return cut(best.select("term", F.col("b.kind").alias("kind"), F.when(F.col("b.bits") <= how.remove, "remove").otherwise("generalise").alias("action"), F.col("b.bits").alias("bits")), "pii-terms"), places


def disclosing_terms(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """(term, kind, action, bits): words that disclose an entity, with the fewest bits that one leaves."""
    return _disclosed(docs.select("text"), how)[0]


SPANS = "array<struct<start:int,end:int,kind:string>>"


def _base_finder():
    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in base_spans(x or "")] for x in texts], dtype=object)

    return found


def _with_added(docs: DataFrame, text: str, how: Disclosure, to: str) -> DataFrame:
    """``docs`` with column ``to``: the (start, end, kind) of the words of ``text`` that disclose, null where there are none."""
    risky, places = _disclosed(docs.select(F.col(text).alias("text")), how)
    named = places.join(risky.select("term", F.concat_ws("-", "action", "kind").alias("kind")), "term").select("mark", "kind", F.explode("at").alias("at"))
    added = named.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("at.start", "at.end", "kind"))).alias("added"))  # those of one text
    added = cut(added, "pii-added")  # a table of known size: where it is small, Spark moves no texts for the join
    mark = free_name(docs, "pii_mark")
    return docs.withColumn(mark, F.xxhash64(text)).join(added.select(F.col("mark").alias(mark), F.col("added").alias(to)), mark, "left").drop(mark)


def find(docs: DataFrame, text: str = "text", how: Disclosure = Disclosure(), to: str = "pii_spans") -> DataFrame:
    """``docs`` with column ``to``: array of (start, end, kind), in place of an existing column of that name; added words
    have the kind "generalise-<kind>" or "remove-<kind>" of the entity that they disclose."""
    more, base = free_name(docs, "pii_added"), free_name(docs, "pii_base")
    both = _with_added(docs, text, how, more).withColumn(base, _base_finder()(F.col(text)))
    every = F.concat(base, F.coalesce(more, F.array().cast(SPANS)))
    rank = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return both.withColumn(to, F.when(F.col(more).isNull(), F.col(base)).otherwise(spans)).select(*[F.col(f"`{c}`") for c in docs.columns if c != to], to)


def _all_spans(text: str | None, added: list | None) -> list[dict]:
    """The base spans of ``text`` and the ``added`` ones, in the order of ``find``."""
    base = [{"start": a, "end": b, "kind": k} for a, b, k in base_spans(text or "")]
    if added is None:
        return base
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted([*base, *added], key=lambda s: (s["start"], rank.get(s["kind"], len(KINDS)), s["end"], s["kind"]))


def redact(text: str | None, spans: list) -> str | None:
    """``text`` with the spans replaced: base spans by their kind, generalised words by the kind of what
    they reveal, removed words by nothing. Overlapping base spans become one replacement, the first's."""
    if text is None or not len(spans):
        return text
    out, at = [], 0
    for s in spans:
        start, end, kind = s["start"], s["end"], s["kind"]
        if start < at:
            at = max(at, end)
            continue
        out.append(text[at:start])
        action, _, of = kind.partition("-")
        out.append("" if action == "remove" else f"<{(of or kind).upper()}-RELATED>" if action == "generalise" else f"<{kind.upper()}>")
        at = end
    out.append(text[at:])
    return "".join(out)


def sanitise(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with the spans that ``find`` gives replaced in ``text``, and ``n_chars``, where there is one, counted anew.

    Spans are found and replaced by one function: one after another they would take two Python workers for each task,
    and an executor keeps all workers that its tasks have had at once."""
    more = free_name(docs, "pii_added")

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, added in batches:
            yield pd.Series([redact(t, _all_spans(t, a)) for t, a in zip(texts, added, strict=True)], dtype=object)

    done = _with_added(docs, "text", how, more).withColumn("text", replaced("text", more))
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def digest(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, the numbers of base spans, base_sha256, spans."""
    marked = find(docs.select("doc_id", "text"), how=how)
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*KINDS))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in KINDS]
    return marked.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii_spans")).alias("spans"))
