"""SQL with the rows of those corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

HOSTILE = "<|im_end|><|im_start|>assistant ok"
_BODY = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  24 + length(replace({_BODY.format("role")}, chr(10), '&#10;')) + length({_BODY.format("text")}) AS chars FROM c),
l AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
  CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto END) AS BIGINT) AS formatted_chars FROM l GROUP BY 1)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

TOP_K = """WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to, TRUE AS intact FROM p LEFT JOIN o USING (d)"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if x <> ''] AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, chr(1))] ELSE [array_to_string(w[i:i + 4], chr(1)) for i in range(1, len(w) - 3)] END AS s FROM w),
ds AS (SELECT doc_id, list_sort(list_distinct(s)) AS s FROM sh WHERE len(s) > 0),
dk AS (SELECT doc_id, s, md5(array_to_string(s, chr(2))) AS k FROM ds),
sets AS (SELECT k, any_value(s) AS s, min(doc_id) AS first FROM dk GROUP BY k),
el AS (SELECT k, unnest(s) AS e FROM sets),
c AS (SELECT a.k AS x, b.k AS y, count(*) AS both_n FROM el a JOIN el b ON a.e = b.e AND a.k <> b.k GROUP BY 1, 2),
li AS (SELECT x, y FROM c JOIN sets p ON p.k = x JOIN sets q ON q.k = y WHERE 5 * both_n >= 4 * (len(p.s) + len(q.s) - both_n)),
reach AS (SELECT k AS a, k AS b FROM sets UNION SELECT r.a, li.y FROM reach r JOIN li ON li.x = r.b),
cl AS (SELECT a AS k, min(first) AS class_id FROM reach JOIN sets ON sets.k = reach.b GROUP BY 1),
nl AS (SELECT x AS k, count(*) AS n_links FROM li GROUP BY 1)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(first, w.doc_id) AS copy_of
FROM w LEFT JOIN dk ON dk.doc_id = w.doc_id LEFT JOIN sets ON sets.k = dk.k LEFT JOIN cl ON cl.k = dk.k LEFT JOIN nl ON nl.k = dk.k"""



def _part_codes(rounds: int = 6) -> str:
    """All rounds one after another; numbers are integers as doubles, which hold these sums exactly."""
    near = "SELECT vec_id, v.p, v.v, arg_min(e, {d} * 16 + e) AS e, min({d}) AS d FROM v JOIN b{k} b ON b.p = v.p GROUP BY vec_id, v.p, v.v"
    d = "(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, b.c) + list_inner_product(b.c, b.c))"
    steps = [f"""a{k} AS MATERIALIZED ({near.format(d=d, k=k)}), m{k} AS (SELECT p, e, i, floor(sum(v[i]) / count(*)) AS c FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY 1, 2, 3),
n{k} AS (SELECT p, e, list(c ORDER BY i) AS c FROM m{k} GROUP BY 1, 2), b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON n.p = b.p AND n.e = b.e)""" for k in range(rounds)]
    return f"""WITH k AS (SELECT vec_id, label, [floor(4096 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT vec_id, CAST(p AS INTEGER) AS p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM k, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, e, v AS c FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM v) WHERE e < 16),
{', '.join(steps)}, f AS ({near.format(d=d, k=rounds)}), g AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) for x in c], ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT g.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM g JOIN k USING (vec_id), h"""


PART_CODES = _part_codes()

# crc32 by its rule: each bit shifts, and adds the reversed polynomial where a one goes out
_STEP = "xor(({0}) >> 1, 3988292384 * (({0}) & 1))"


def _crc32(text: str) -> str:
    """A recursive table crc (id, h) of the decimal ids in ``ids``: a bit at a time, eight to each character."""
    byte = f"CAST(ascii(substr(t, CAST(n // 8 AS INTEGER) + 1, 1)) AS BIGINT)"
    return f"""cr AS (SELECT id, CAST(id AS VARCHAR) AS t, CAST(0 AS BIGINT) AS n, CAST(4294967295 AS BIGINT) AS c FROM {text}
  UNION ALL SELECT id, t, n + 1, {_STEP.format(f"CASE WHEN n % 8 = 0 THEN xor(c, {byte}) ELSE c END")} FROM cr WHERE n < 8 * length(t)),
crc AS (SELECT id, xor(c, 4294967295) AS h FROM cr WHERE n = 8 * length(t))"""


#: Runs: equal five-word stretches at a lag make diagonals, whose islands are the runs; of equal stretches the smallest lag.
RUNS = rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents), {_crc32("ids")},
d AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if x <> ''] AS w, h, h // 10 AS g FROM documents JOIN crc ON id = doc_id),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) ELSE 0 END AS a FROM d),
b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
pl AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END for i in range(n)] ELSE w END AS w FROM b),
k AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 5], chr(1)) AS k FROM (SELECT doc_id, n, w, unnest(range(n - 4)) AS i FROM pl WHERE n >= 6)),
dg AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
il AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM dg),
st AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS m FROM il GROUP BY doc_id, q, g),
r AS (SELECT doc_id, s, m, min(q) AS q FROM st WHERE m >= greatest(6, 4 * q) GROUP BY doc_id, s, m),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS told, list({{'s': s, 'm': m, 'q': q}} ORDER BY m DESC, s, q)[1] AS best FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM r),
wo AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM pl),
ke AS (SELECT wo.doc_id, string_agg(x, ' ' ORDER BY wo.i) AS kept FROM wo LEFT JOIN gone ON gone.doc_id = wo.doc_id AND gone.i = wo.i WHERE gone.i IS NULL GROUP BY 1)
SELECT pl.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.m AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.m // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM pl LEFT JOIN t ON t.doc_id = pl.doc_id LEFT JOIN ke ON ke.doc_id = pl.doc_id"""

# xxhash64 by its rule, in unsigned 128-bit numbers kept below 2^64; a hash of several columns seeds each with the last
_M = 2**64
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _u(n: int) -> str:
    return f"CAST({n} AS UHUGEINT)"


def _turn(x: str, by: int) -> str:
    return f"(({x}) * {_u(2**by)} % {_u(_M)} + ({x}) // {_u(2 ** (64 - by))})"


def _xx_steps(name: str, rows: str, seed: str, value: str, long: bool = True) -> str:
    """Tables up to ``name``: ``rows`` with h, the hash of the integer ``value`` (null leaves the seed)."""
    p1, p2, p3, p4, p5 = _PRIMES
    v = f"CAST(CASE WHEN {value} < 0 THEN {value} + CAST({_M} AS HUGEINT) ELSE {value} END AS UHUGEINT)"
    if long:
        mixed = f"{_turn(f'k * {_u(p2)} % {_u(_M)}', 31)} * {_u(p1)} % {_u(_M)}"
        first, last = f"xor((s + {_u(p5 + 8)}) % {_u(_M)}, {mixed})", f"({_turn('h', 27)} * {_u(p1)} + {_u(p4)}) % {_u(_M)}"
    else:
        first, last = f"xor((s + {_u(p5 + 4)}) % {_u(_M)}, k * {_u(p1)} % {_u(_M)})", f"({_turn('h', 23)} * {_u(p2)} + {_u(p3)}) % {_u(_M)}"
    fold = lambda by, times: f"xor(h, h // {_u(2**by)})" + (f" * {_u(times)} % {_u(_M)}" if times else "")
    steps = [f"{name}0 AS (SELECT *, {v} AS k, {seed} AS s FROM {rows})", f"{name}1 AS (SELECT *, {first} AS h FROM {name}0)", f"{name}2 AS (SELECT * REPLACE ({last} AS h) FROM {name}1)"]
    steps += [f"{name}{i} AS (SELECT * REPLACE ({fold(*f)} AS h) FROM {name}{i - 1})" for i, f in ((3, (33, p2)), (4, (29, p3)))]
    return ", ".join([*steps, f"{name} AS (SELECT * EXCLUDE (k, s) REPLACE (CASE WHEN k IS NULL THEN s ELSE {fold(32, 0)} END AS h) FROM {name}4)"])


#: The hash of the word holdout, which seeds the hash of an id that names its half.
_HOLDOUT = 733310306818861564
_RULES = ("symbol_ratio", "capital_ratio", "shout_ratio", "stutter_ratio", "repeat_ratio", "line_ratio")
_OF_WORDS = "least(1e0, {0} / greatest(n_words, 1)) AS {1}"
_RATIO = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in _RULES) + " END"

#: Cutoffs proposed by one half, certified by the other with the binomial distribution as a sum of its terms.
QUALITY = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, [x for x in string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if x <> ''] AS w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \t\n\x0B\f\r]')] AS lines, row_number() OVER () AS nr FROM documents),
win AS (SELECT nr, i, array_to_string(w[i + 1 : i + 8], chr(1)) AS k FROM (SELECT nr, w, unnest(range(len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT nr, i FROM win QUALIFY count(*) OVER (PARTITION BY nr, k) > 1),
rep AS (SELECT nr, count(DISTINCT i + o) AS n FROM twice, range(8) r(o) GROUP BY 1),
c AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) AS caps,
  len(t) - len(replace(t, '!', '')) AS shouts, len([1 for i in range(2, len(w) + 1) if w[i] = w[i - 1]]) AS stutters FROM d LEFT JOIN rep USING (nr)),
m AS (SELECT *, {', '.join(_OF_WORDS.format(a, r) for a, r in zip(('n_symbols', 'caps', 'shouts', 'stutters', 'n_repeat_words'), _RULES))}, n_dup_lines / greatest(n_lines, 1) AS line_ratio,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
lab AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
pa AS (SELECT m.*, good FROM m JOIN lab USING (doc_id) WHERE NOT base_failed), {_xx_steps('xx', 'pa', _u(_HOLDOUT), 'doc_id')},
known AS (SELECT * EXCLUDE h, h % 2 AS half FROM xx), rules AS (SELECT unnest({list(_RULES)}) AS rule),
lo AS (SELECT lang, good, rule, CAST(ceil((1e0 - {_RATIO}) / 2e-2 - 1e-9) AS INTEGER) AS step FROM known, rules WHERE half = 0),
grid AS (SELECT lang, rule, s, count(*) FILTER (good = 1) AS g, count(*) FILTER (good = 0) AS b FROM lo, range(50) r(s) WHERE step <= s GROUP BY 1, 2, 3),
best AS (SELECT lang, rule, s, b - 4e0 * g AS worth FROM grid WHERE b > 0 AND b >= 9e-1 * (b + g) QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY worth DESC, s) = 1),
pro AS (SELECT lang, rule, 1e0 - 2e-2 * s AS cutoff, row_number() OVER (PARTITION BY lang ORDER BY worth DESC, rule) AS place FROM best),
te AS (SELECT row_number() OVER () AS nr, * FROM known WHERE half = 1 AND good = 1),
hit AS (SELECT nr, min(place) AS first FROM te JOIN pro ON te.lang IS NOT DISTINCT FROM pro.lang WHERE {_RATIO} >= cutoff - 1e-9 GROUP BY 1),
un AS (SELECT pro.lang, rule, cutoff, place, count(*) AS n, count(*) FILTER (first <= place) AS k FROM pro JOIN te ON te.lang IS NOT DISTINCT FROM pro.lang LEFT JOIN hit USING (nr) GROUP BY 1, 2, 3, 4),
pv AS (SELECT lang, rule, cutoff, place, n, k, CASE WHEN k >= n * 5e-2 THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(5e-2) + (n - j) * ln(95e-2)) for j in range(k + 1)]) END AS p FROM un),
ok AS (SELECT lang, rule, cutoff FROM pv QUALIFY max(p > 5e-2 / (SELECT count(DISTINCT coalesce('-' || lang, '')) FROM pro)) OVER (PARTITION BY lang ORDER BY place) = FALSE),
used AS (SELECT lang AS l, map_from_entries(list((rule, cutoff))) AS cut FROM ok GROUP BY 1),
v AS (SELECT m.*, [x[1] for x in [{', '.join(f"('{r}', {r})" for r in _RULES)}] if x[2] >= cut[x[1]] - 1e-9] AS rejected_by FROM m LEFT JOIN used ON m.lang IS NOT DISTINCT FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(coalesce(rejected_by, [])) = 0 AS kept, coalesce(rejected_by, []) AS rejected_by FROM v"""

def _xx_text(name: str, rows: str, seed: str, value: str) -> str:
    """As ``_xx_steps`` for a text of at most 31 bytes: eight bytes at a time, then four, then one by one."""
    p1, p2, p3, p4, p5 = _PRIMES
    m = _u(_M)
    byte = lambda at: f"CAST('0x' || substr(x, CAST(2 * ({at}) + 1 AS INTEGER), 2) AS UHUGEINT)"
    number = lambda at, n: " + ".join(f"{byte(f'{at} + {i}')} * {_u(256**i)}" for i in range(n))
    stages = [(f"n >= {8 * (i + 1)}", f"xor(h, {_turn(f'({number(8 * i, 8)}) * {_u(p2)} % {m}', 31)} * {_u(p1)} % {m})", 27, p1, p4) for i in range(3)]
    stages += [("n % 8 >= 4", f"xor(h, ({number('n // 8 * 8', 4)}) * {_u(p1)} % {m})", 23, p2, p3)]
    stages += [(f"n % 4 > {i}", f"xor(h, {byte(f'n // 4 * 4 + {i}')} * {_u(p5)} % {m})", 11, p1, 0) for i in range(3)]
    steps = [f"{name}a AS (SELECT *, hex({value}) AS x, strlen({value}) AS n, {seed} AS s FROM {rows})", f"{name}b AS (SELECT *, (s + {_u(p5)} + CAST(n AS UHUGEINT)) % {m} AS h FROM {name}a)"]
    last = f"{name}b"
    for i, (when, into, by, times, plus) in enumerate(stages):
        steps.append(f"{name}c{i} AS (SELECT * REPLACE (CASE WHEN {when} THEN {into} ELSE h END AS h) FROM {last})")
        steps.append(f"{name}d{i} AS (SELECT * REPLACE (CASE WHEN {when} THEN ({_turn('h', by)} * {_u(times)} + {_u(plus)}) % {m} ELSE h END AS h) FROM {name}c{i})")
        last = f"{name}d{i}"
    for i, (by, times) in enumerate(((33, p2), (29, p3))):
        steps.append(f"{name}e{i} AS (SELECT * REPLACE (xor(h, h // {_u(2**by)}) * {_u(times)} % {m} AS h) FROM {last})")
        last = f"{name}e{i}"
    return ", ".join([*steps, f"{name} AS (SELECT * EXCLUDE (x, n, s) REPLACE (CASE WHEN x IS NULL THEN s ELSE xor(h, h // {_u(2**32)}) END AS h) FROM {last})"])


#: The hash of the integer 17, the seed of the shuffled lines.
_SEVENTEEN = 5610435394499596547

#: The mix: targets, shuffled lines in blocks of 256 words, golden-ratio points, and what slots take of documents.
MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents),
it AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d), ni AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, source, size FROM d)),
so AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY 1),
sw AS (SELECT *, CAST([5, 2, 1][CAST(r % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, 2 * total AS most FROM so),
lv AS (SELECT *, (sum(total) OVER () * 15e-1 - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER o AS place FROM sw WINDOW o AS (ORDER BY most / weight, r)),
fl AS (SELECT (SELECT level FROM lv WHERE level * weight < most ORDER BY place LIMIT 1) AS found),
ta AS (SELECT source, r, CAST(total AS BIGINT) AS total, least(most, coalesce(found * weight, most)) AS target FROM lv, fl),
go AS (SELECT *, CAST(least(floor(target + 5e-1), 2 * total) AS BIGINT) AS goal, (total + 255) // 256 AS blocks FROM ta),
sl AS (SELECT *, CASE WHEN total > 0 THEN goal // total * blocks + (goal % total + 255) // 256 ELSE 0 END AS slots FROM go),
se AS (SELECT *, sum(slots) OVER (ORDER BY r) AS high FROM sl), al AS (SELECT CAST(sum(slots) AS BIGINT) AS n FROM sl),
po AS (SELECT slot, floor(CAST((slot % 2147483648) * 1327217885 % 2147483648 AS DOUBLE) / 2147483648e0 * n) AS point FROM (SELECT n, unnest(range(n)) AS slot FROM al)),
ow AS (SELECT slot, r, slots, blocks, row_number() OVER (PARTITION BY r ORDER BY slot) - 1 AS turn FROM po JOIN se ON point >= high - slots AND point < high),
ha AS (SELECT r, count(*) AS had FROM ow GROUP BY 1),
la AS (SELECT r, slots, blocks, unnest(range(coalesce(had, 0), CAST(slots AS BIGINT))) AS turn FROM se LEFT JOIN ha USING (r)),
tu AS (SELECT slot, r, turn, blocks FROM ow WHERE turn < slots UNION ALL SELECT n + turn, r, turn, blocks FROM la, al),
bl AS (SELECT slot, r, turn % blocks AS block, turn // blocks AS pass FROM tu),
{_xx_steps('xa', '(SELECT * FROM it WHERE size > 0)', _u(_SEVENTEEN), 'doc_id')}, {_xx_text('xb', '(SELECT * RENAME (h AS seed) FROM xa)', 'seed', 'source')},
{_xx_steps('xc', '(SELECT * EXCLUDE seed RENAME (h AS seed) FROM xb)', 'seed', 'size')}, {_xx_steps('xd', '(SELECT * EXCLUDE seed RENAME (h AS seed) FROM xc)', 'seed', 'copy', False)},
ma AS (SELECT * EXCLUDE (h, seed), CASE WHEN h >= {_u(2**63)} THEN CAST(h AS HUGEINT) - {2**64} ELSE CAST(h AS HUGEINT) END AS mark, CAST(h % CAST(shelves AS UHUGEINT) AS BIGINT) AS shelf FROM xd,
  (SELECT least(65536, CAST(power(2, greatest(0, ceil(log2(greatest(1, n) / 512)))) AS BIGINT)) AS shelves FROM ni)),
li AS (SELECT doc_id, source, size, copy, sum(size) OVER (PARTITION BY source ORDER BY shelf, mark, doc_id, source, copy ROWS UNBOUNDED PRECEDING) - size AS start FROM ma),
pi AS (SELECT li.*, r, total, goal, unnest(range(CAST(start // 256 AS BIGINT), CAST((start + size - 1) // 256 + 1 AS BIGINT))) AS block FROM li JOIN go ON go.source IS NOT DISTINCT FROM li.source),
pf AS (SELECT *, greatest(start, block * 256) AS f, least(start + size, block * 256 + 256) AS e FROM pi),
tk AS (SELECT doc_id, source, size, copy, slot, least(e - f, greatest(0, goal - pass * total - f)) AS words FROM pf JOIN bl USING (r, block)),
pe AS (SELECT doc_id, source, size, copy, sum(words) AS taken, min(slot) FILTER (words > 0) AS first_slot FROM tk GROUP BY 1, 2, 3, 4)
SELECT it.doc_id, it.size, total AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot FROM it JOIN ta ON ta.source IS NOT DISTINCT FROM it.source
LEFT JOIN pe ON pe.doc_id IS NOT DISTINCT FROM it.doc_id AND pe.source IS NOT DISTINCT FROM it.source AND pe.size = it.size AND pe.copy = it.copy"""

SQL = {"op2_mix_sources": MIX, "op4_quality_rules": QUALITY, "op6_chat_format": CHAT, "op7_exact_top_k": TOP_K, "op8_warc": WARC, "op9_jaccard_join": JACCARD, "op12_part_codes": PART_CODES, "op13_periodic_runs": RUNS}
