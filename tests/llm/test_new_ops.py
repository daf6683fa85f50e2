"""Quality by compression, vector codes by parts and periodic runs, against brute force and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoprob.llm import part_codes, periodic, quality_compression
from chronoprob.llm.queries import op11_quality_compression, op12_part_codes, op13_periodic_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# periodic runs


def plain_runs(w, least=6, times=4):
    """All runs, by trying each lag."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, m, q) for (s, m), q in best.items())


def plain_digest(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize(("least", "times"), [(6, 4), (9, 3), (66, 4), (1, 5)])
def test_runs_of_random_sequences(least, times):
    rng, how = random.Random(3), periodic.Runs(least, times)
    for _ in range(1500):
        kind = rng.randrange(4)
        if kind == 0:
            w = [rng.randrange(2) for _ in range(rng.randrange(60))]
        elif kind == 1:
            base = [rng.randrange(3) for _ in range(rng.randrange(1, 15))]
            w = [rng.randrange(3) for _ in range(rng.randrange(9))] + base * rng.randrange(2, 9) + [rng.randrange(3) for _ in range(rng.randrange(9))]
        elif kind == 2:
            inner = [rng.randrange(2) for _ in range(rng.randrange(1, 4))] * rng.randrange(3, 8) + [7]
            w = inner * rng.randrange(1, 7) + inner[: rng.randrange(len(inner))]
        else:
            w = [0, 1] * rng.randrange(50) + [rng.randrange(2)] + [1] * rng.randrange(80)
        assert periodic.runs_of(np.array(w, dtype=np.int64), how) == plain_runs(w, least, times), w


def test_seeds_grow_with_the_words():
    for w in (np.zeros(20_000, dtype=np.int64), np.arange(20_000) % 2, np.arange(20_000) % 4_999):
        found = sum(len(places) for places, _ in periodic.seeds(w))
        assert found <= 20_000
        assert len(periodic.runs_of(w)) == 1


def test_runs_need_three_periods():
    with pytest.raises(ValueError):
        periodic.Runs(6, 2)


def test_run_digests_equal_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows if len(r.text or "") < 6_000}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert sum(r[1] for r in got.values()) > 0
    for i, t in texts.items():
        assert got[i] == plain_digest(i, t)


def test_run_hard_cases(spark):
    texts = [None, "", " \n", "a", "a a a a a a", "a\x1cb " * 8, "x " * 3000, "Ü ß Ü ß Ü ß Ü ß", "a b a b a b a", "z" * 5000] * 12
    got = {r.doc_id: tuple(r) for r in periodic.digest(periodic.with_planted_runs(docs_of(spark, texts))).collect()}
    assert got == {i: plain_digest(i, t) for i, t in enumerate(texts)}
    assert periodic.digest(docs_of(spark, [])).count() == 0


def test_runs_keep_other_columns(spark):
    rows = spark.createDataFrame([(1, "so so so so so so it is", "r", 5, None)], "`a.b` int, text string, runs string, _found int, z string")
    found = periodic.find_runs(rows)
    assert found.columns == ["a.b", "text", "_found", "z", "n_words", "runs", "collapsed"]
    r = found.first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (8, [(0, 6, 1)], "so it is")


# codes by parts


def plain_codes(rows, parts=8, k=16, rounds=6, scale=4096):
    """(codes, errors by id, digest) by trying all entries, in Python's integers."""
    q = {i: [int(np.floor(float(x) * scale)) for x in v] for i, v in rows}
    ids, width = sorted(q), len(next(iter(q.values()))) // parts
    books, codes = [], {i: "" for i in ids}
    errors = dict.fromkeys(ids, 0)
    for p in range(parts):
        part = {i: q[i][p * width : (p + 1) * width] for i in ids}
        book = [list(part[i]) for i in ids[:k]]

        def nearest(v):
            return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            groups = {}
            for i in ids:
                groups.setdefault(nearest(part[i])[1], []).append(part[i])
            for j, g in groups.items():
                book[j] = [sum(c) // len(g) for c in zip(*g)]
        for i in ids:
            d, j = nearest(part[i])
            codes[i] += f"{j:02x}"
            errors[i] += d
        books += [x for e in book for x in e]
    return codes, errors, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.float32(v)], int(i % 3) if i % 7 else None) for i, v in zip(rng.permutation(300), rng.normal(0, 0.01, (300, 16)))]
    rows += [(1000 + i, rows[0][1], 1) for i in range(40)]  # copies, and below values that tie
    rows += [(2000 + i, [float(x) / 4096 for x in rng.integers(-2, 3, 16)], 2) for i in range(80)]
    bad = [(3000, None, 1), (3001, [None] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [float("inf")] * 16, 1)]
    codes, errors, digest = plain_codes([(i, v) for i, v, _ in rows])
    label_of = {i: k for i, _, k in rows}
    by_label = {k: sum(e for i, e in errors.items() if label_of[i] == k) for k in set(label_of.values())}
    for how in (part_codes.Codes(), part_codes.Codes(block=64, leaf=3)):
        got = part_codes.with_label_errors(vectors_of(spark, rows + bad).repartition(3), how).collect()
        assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {i: (codes[i], errors[i], by_label[label_of[i]], digest) for i in codes}
        assert len(got) == len(rows)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_trees_assign_as_brute_force(k, leaf):
    rng = np.random.default_rng(k)
    for spread in (2, 1000):
        points = rng.integers(-spread, spread + 1, (200, 3)) + 5000 * rng.integers(0, 2, (200, 1))
        entries = points[rng.integers(0, 200, k)]
        points = points[part_codes.tree_order(points, leaf)]
        counts, sums, codes, errors = part_codes.nearest(points, entries, leaf)
        apart = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (codes == apart.argmin(axis=1)).all() and (errors == apart.min(axis=1)).all()
        assert (counts == np.bincount(codes, minlength=k)).all()
        assert all((sums[j] == points[codes == j].sum(axis=0)).all() for j in range(k))


def test_whole_nodes_are_assigned_by_cached_sums():
    points = np.concatenate([np.zeros((64, 2), dtype=np.int64), np.full((64, 2), 1_000_000)])
    entries = np.array([[1, 1], [999_999, 999_999]])
    counts, sums, codes, _ = part_codes.nearest(points, entries, leaf=200)  # one leaf: only bounds of nodes can tell
    assert counts.tolist() == [64, 64] and sums.tolist() == [[0, 0], [64_000_000, 64_000_000]]
    assert codes.tolist() == [0] * 64 + [1] * 64


def test_code_hard_cases(spark):
    assert part_codes.with_label_errors(vectors_of(spark, [])).count() == 0
    few = part_codes.with_label_errors(vectors_of(spark, [(1, [0.5] * 8, 1), (1, [0.25] * 8, None), (None, [1e30] * 8, 1)])).collect()
    assert sorted((r.vec_id is None, r.code) for r in few) == [(False, "00" * 8), (False, "01" * 8), (True, "02" * 8)]
    uneven = part_codes.with_label_errors(vectors_of(spark, [(1, [], 1), (2, [1.0], 1), (3, [1.0] * 9, 1)])).collect()
    assert sorted(r.error for r in uneven) == [0, 0, 0]
    nothing = part_codes.with_label_errors(vectors_of(spark, [(1, [], 1)])).collect()
    assert [(r.code, r.error) for r in nothing] == [("00" * 8, 0)]
    large = part_codes.with_label_errors(vectors_of(spark, [((1 << 60) + i, [float(i)] * 8, None) for i in range(40)]))
    assert sorted(r.vec_id for r in large.collect()) == [(1 << 60) + i for i in range(40)]


def test_codes_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op12_part_codes(spark, sf_dir).collect()
    codes, errors, digest = plain_codes(rows) if len(rows) <= 600 else (None, None, None)
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: (codes[i], errors[i]) for i in codes}
    assert {r.codebooks_sha256 for r in got} == {digest}


# quality by compression


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = op11_quality_compression(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert area > 0.95
    assert sum(r.predicted for r in got if r.quality == 1) > 0.95 * len(good)


def test_quality_score_equals_a_plain_version(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "meadow", "harbour"]) for _ in range(90)) for _ in range(120)]
    bad = [" ".join(rng.choice(["#$%", "click", "||||", "!!!!", "BUY", "$$$"]) for _ in range(90)) for _ in range(120)]
    texts = [t for pair in zip(good, bad) for t in pair] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_compression.classify(docs, labels).collect()}
    known = quality_compression.labelled_texts(docs.withColumn("held_out", F.lit(False)), labels)
    pairs = quality_compression.train_dictionaries(docs, known)
    scale = quality_compression.Scale(pairs)
    for i, t in enumerate(texts):
        assert got[i].difference == scale.difference(t)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i].predicted == 1 - i % 2 for i in range(240))
    ordered = sorted(got.values(), key=lambda r: r.difference)
    assert [r.score for r in ordered] == sorted(r.score for r in ordered)
    assert got[240].score == got[241].score


def test_held_out_labels_are_never_read(spark):
    texts = [f"{w} " * 60 for i in range(150) for w in (f"good{i} calm text", f"$$$ {i} ###")]
    docs = docs_of(spark, texts)
    out = quality_compression.held_out(F.col("doc_id"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(out.eqNullSafe(True), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality_compression.classify(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_windows_of_the_sample(spark):
    texts = ["".join(chr(97 + (i * 7 + k) % 26) for k in range(1000)) for i in range(30)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    known = quality_compression.labelled_texts(docs, labels)
    every = {(r.quality, r.piece) for r in quality_compression.sample_windows(docs, known).collect()}
    wanted = {r.mark: r.quality for r in known.where("teaches").collect()}
    marks = {r.doc_id: r.m for r in docs.select("doc_id", F.xxhash64("text").alias("m")).collect()}
    assert every == {(wanted[marks[i]], t[at : at + 64]) for i, t in enumerate(texts) if marks[i] in wanted for at in range(0, 1000, 64)}
    some = quality_compression.sample_windows(docs, known, quality_compression.Sizes(fit_windows=20)).count()
    assert 0 < some < 90


def test_quality_hard_cases(spark):
    docs = docs_of(spark, [None, "", "one", "x " * 3000, "one"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_compression.classify(docs, none).collect()} == {0.5}
    good = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (0, 1)], "doc_id long, quality int")
    assert {r.score for r in quality_compression.classify(docs, good).collect()} == {1.0}
    assert quality_compression.classify(docs_of(spark, []), good).count() == 0
    with pytest.warns(UserWarning, match="no dictionary"):
        both = quality_compression.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int"))
    assert both.count() == 5


# toxicity as a whole


def test_toxicity_equals_a_plain_version(spark):
    """Every step after the dictionaries in plain Python: window differences, features, the curve's order, thresholds."""
    from chronoprob.llm import toxicity

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["Scumbagger", "MORONICAL", "patheticus"])
        texts.append(" ".join(w))
    texts += [texts[0], None, "", "x " * 5000]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    how = toxicity.Distance()
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))}
    mark = {r.id: r.k for r in spark.range(600).select("id", F.pmod(F.xxhash64(F.lit("quarter"), "id"), F.lit(4)).alias("k")).collect()}
    learn = spark.createDataFrame([(texts[i], int(i % 4 == 0)) for i in range(600) if not out[i] and mark[i] > 0], "text string, toxic int")
    gauge = toxicity.Gauge(toxicity.train_dictionaries(learn), how)
    rows = {}
    for i, t in enumerate(texts):
        d = sorted(gauge.differences(t))
        rows[i] = (d[-1], sum(d[-2:]), sum(d) / len(d), np.log1p(len(d))) if d else (0.0, 0.0, 0.0, 0.0)
    x = np.array([[a, b, c, n, *[max(a - k, 0.0) for k in (2, 4, 6, 12)]] for a, b, c, n in rows.values()])
    fit = [i for i in range(600) if not out[i] and mark[i] == 0]
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    model = LogisticRegression(maxIter=50, regParam=1e-4).fit(spark.createDataFrame([(Vectors.dense(x[i]), float(i % 4 == 0)) for i in fit], ["features", "label"]))
    want = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    assert np.array([got[i].score for i in range(len(texts))]) == pytest.approx(want, abs=1e-6)
    assert all(got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == out[i] for i in got)
    held = [i for i in range(600) if out[i]]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95


def test_toxicity_without_selection_and_without_text(spark):
    from chronoprob.llm import toxicity

    rng = random.Random(22)
    texts = [(" ".join(rng.choice(["river", "stone", "cloud"]) for _ in range(30)) + f" {k}", 0) for k in range(80)] + [(" ".join(rng.choice(["scum", "trash"]) for _ in range(30)) + f" {k}", 1) for k in range(40)]
    made = toxicity.train_dictionaries(spark.createDataFrame(texts, "text string, toxic int"), toxicity.Distance(select=False, ordinary_bytes=1024))
    gauge = toxicity.Gauge(made, toxicity.Distance())
    assert max(gauge.differences("scum trash scum trash")) > 0  # what ordinary text has stands in both dictionaries
    assert max(gauge.differences("river stone cloud river")) <= 0
    with pytest.warns(UserWarning, match="no dictionary"):
        assert toxicity.train_dictionaries(spark.createDataFrame([("a", 0), ("b", 1)], "text string, toxic int"), toxicity.Distance(select=False)) is None


def test_toxic_windows_weigh_the_same_in_smaller_tables_and_by_dictionary(monkeypatch):
    """Tables with room for the dictionary only, and many windows by one dictionary before the next, change no size."""
    import zstandard

    from chronoprob.llm import toxicity

    rng = random.Random(8)
    some = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    said = lambda n: f" {' '.join(rng.choice(some) for _ in range(n))} ".encode()
    own, shared = said(700), said(2500)
    made = [(b"\0" * len(own) + shared + toxicity.LEAD, own + shared + toxicity.LEAD)]
    how = toxicity.Distance()
    shape = zstandard.ZstdCompressionParameters.from_level(how.level, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    plain = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=shape).compress for c in made[0]]
    texts = [None, "", *[said(rng.randint(1, 60)).decode() for _ in range(200)]]
    expected = [[len(plain[0](toxicity.LEAD + w)) - len(plain[1](toxicity.LEAD + w)) for w in toxicity.windows(t)] for t in texts]
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    monkeypatch.setattr(toxicity, "KEPT", 40)
    assert any(map(any, expected)) and list(toxicity.Gauge(made, how).all_differences(texts)) == expected


def test_ordinary_text_is_counted_only_where_toxic_text_can_be_rich(spark):
    """What no toxic document holds is not counted in ordinary ones, and the rich sequences are those of all counts."""
    from chronoprob.llm import toxicity

    rng = random.Random(3)
    said = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    usual, foul = [f"word{i}" for i in range(60)], [f"rotten{i}" for i in range(4)]
    rows = [(said(usual, 20), 0) for _ in range(80)] + [(said(usual, 12) + " " + said(foul, 4), 1) for _ in range(30)]
    learn = spark.createDataFrame(rows, "text string, toxic int")
    among = toxicity.supported_grams(learn, 30)
    every, some = toxicity.gram_counts(learn), toxicity.gram_counts(learn, among=among)
    assert {r.gram for r in some.collect()} == among and len(among) < every.count()
    assert toxicity.rich_grams(some, 30, 80) == toxicity.rich_grams(every, 30, 80) != []
