"""DuckDB SQL for the core queries that SQL can express."""

LOAN = """
loan AS (
    SELECT o_orderkey AS id, epoch_us(o_orderdate) AS u0, (24 + floor(o_totalprice)::BIGINT % 800) AS hours,
        epoch_us(o_orderdate) + (24 + floor(o_totalprice)::BIGINT % 800) * 3600000000 AS u1,
        (isodow(o_orderdate) - 1)::INT AS weekday, hour(o_orderdate)::INT AS hour, CASE WHEN (o_orderkey // 7) % 3 < 2 THEN 'female' ELSE 'male' END AS gender,
        (o_orderkey // 3) % 4 + 1 AS borrowers, o_orderkey % 19 + 6 AS term,
        c_mktsegment AS sector, n_name AS country, o_orderpriority AS activity, o_totalprice AS amount, o_orderstatus AS status, year(o_orderdate) AS year
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""
DAY = 86_400_000_000
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _pool(condition: str, columns: str, keys: str = "f.sector = s.sector") -> str:
    return f"""WITH {LOAN} SELECT f.id, count(s.id)::BIGINT AS n{columns} FROM loan f
        LEFT JOIN loan s ON {keys} AND s.id <> f.id AND {condition} GROUP BY f.id"""


CURRENT = "s.u0 <= f.u0 AND f.u0 < s.u1"
RECENT = f"f.u0 - s.u0 >= {35 * DAY} AND f.u0 - s.u0 < {65 * DAY}"
AGE = f", round(coalesce(sum(pow(2.0, -(f.u0 - s.u0) / (7.0 * {DAY}))), 0), 9) AS v"

def _texted(texts: str) -> str:
    """Listings with a whole text each, and the similarity of each two texts. texts: SQL of (place, text) with place from 0 upwards."""
    return f"""{LOAN},
doc AS (SELECT place, {TOKENS.format("text")} AS tokens FROM ({texts})),
nd AS (SELECT count(*) AS nd FROM doc),
texted AS (SELECT loan.*, place, tokens FROM loan, nd, doc WHERE place = loan.id % nd),
known AS (SELECT place, count(*) AS k FROM texted WHERE year <= 2000 GROUP BY place),
tf AS (SELECT place, word, count(*) AS tf FROM (SELECT place, unnest(tokens) AS word FROM doc) GROUP BY ALL),
idf AS (SELECT word, ln((1 + (SELECT sum(k) FROM known)) / (1.0 + sum(k))) + 1 AS idf FROM tf JOIN known USING (place) GROUP BY word),
x AS (SELECT place, word, tf * idf AS x FROM tf JOIN idf USING (word)),
vec AS (SELECT place, word, x / sqrt(sum(x * x) OVER (PARTITION BY place)) AS w FROM x),
alike AS (SELECT a.place AS i, b.place AS j, sum(a.w * b.w) AS dot FROM vec a JOIN vec b ON a.word = b.word GROUP BY ALL)"""


TEXTED = _texted("SELECT conv_id AS place, text FROM conversations WHERE turn = 0")
DESCRIBED = _texted("SELECT doc_id AS place, text FROM documents")


def _homogeneity(name: str, condition: str, weight: str) -> str:
    return f"""{name}_p AS (SELECT f.id, f.place AS i, s.place AS j, {weight} AS g FROM texted f JOIN texted s ON f.sector = s.sector AND s.id <> f.id AND {condition}),
{name}_d AS (SELECT id, count(*) AS n, sum(g) AS v, sum(g * coalesce(dot, 0)) AS dot FROM {name}_p p LEFT JOIN alike a ON a.i = p.i AND a.j = p.j GROUP BY id),
{name} AS (SELECT loan.id, coalesce(n, 0)::BIGINT AS n, coalesce(v, 0) AS v, dot / v AS h FROM loan LEFT JOIN {name}_d d ON d.id = loan.id)"""


CUR = _homogeneity("cur", CURRENT, "1.0")
REC = _homogeneity("rec", RECENT, f"pow(2.0, -(f.u0 - s.u0) / (7.0 * {DAY}))")
MEASURES = f"""{TEXTED}, {CUR}, {REC},
m AS (SELECT loan.*, ln(1 + cur.n) AS c, cur.h AS h, rec.v AS v, rec.h AS g FROM loan JOIN cur ON cur.id = loan.id JOIN rec ON rec.id = loan.id),
par AS (SELECT avg(c) AS mc, stddev_samp(c) AS sc, avg(h) AS mh, stddev_samp(h) AS sh, avg(v) AS mv, stddev_samp(v) AS sv, avg(g) AS mg, stddev_samp(g) AS sg FROM m WHERE year <= 2000),
z AS (SELECT m.*, (c - mc) / sc AS z_c, (h - mh) / sh AS z_h, (v - mv) / sv AS z_v, (g - mg) / sg AS z_g FROM m, par)"""

FIXED = f"""{LOAN}, f AS (
    SELECT *, ln(1 + hours) AS y, (hours <= 72)::INT AS fast, 5.0 + (id % 7) / 10.0 AS pred, 0.05 + (id % 5) / 10.0 AS prob, max(u0) OVER () AS last FROM loan WHERE year > 2000
), f35 AS (SELECT * FROM f WHERE u0 <= last - 35 * 86400000000), f72 AS (SELECT * FROM f WHERE u0 <= last - 72 * 3600000000)"""
DOCS = f"doc AS (SELECT doc_id AS id, {TOKENS.format('text')} AS tokens FROM documents)"
PHRASES = f"""tok AS (SELECT doc_id AS id, source, {TOKENS.format("text")} AS t FROM documents),
gram AS (SELECT id, source, i, array_to_string(t[i : i + 4], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(t) - 3)) AS i FROM tok WHERE len(t) >= 5)),
phrases AS (SELECT phrase, count(DISTINCT id)::BIGINT AS docs, count(DISTINCT source)::BIGINT AS countries FROM gram GROUP BY phrase HAVING count(DISTINCT id) >= 4 AND count(DISTINCT source) >= 3)"""


#: Two slopes within countries, by the inverse of a 2 x 2 matrix; scores summed by country, week and both.
WITHIN = f"""WITH p AS ({_pool(CURRENT, ", any_value(f.amount) AS amount, any_value(f.hours) AS hours, any_value(f.country) AS country, any_value(f.u0) AS u0")}),
r AS (SELECT n / 10.0::DOUBLE AS x1, ln(1 + amount) AS x2, ln(1 + hours) AS y, country, u0 // {7 * DAY} AS week FROM p),
c AS (SELECT country, week, x1 - avg(x1) OVER g AS x1, x2 - avg(x2) OVER g AS x2, y - avg(y) OVER g AS y FROM r WINDOW g AS (PARTITION BY country)),
s AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS d, sum(x1 * y) AS e, sum(x2 * y) AS f FROM c),
i AS (SELECT d / (a * d - b * b) AS i11, -b / (a * d - b * b) AS i12, a / (a * d - b * b) AS i22, e, f FROM s),
t AS (SELECT *, i11 * e + i12 * f AS b1, i12 * e + i22 * f AS b2 FROM i),
u AS (SELECT country, week, x1 * (y - b1 * x1 - b2 * x2) AS u1, x2 * (y - b1 * x1 - b2 * x2) AS u2 FROM c, t),
k AS (
    SELECT 1 AS sign, sum(u1) AS u1, sum(u2) AS u2, 'c' AS kind FROM u GROUP BY country UNION ALL SELECT 1, sum(u1), sum(u2), 'w' FROM u GROUP BY week
    UNION ALL SELECT -1, sum(u1), sum(u2), 'cw' FROM u GROUP BY country, week
), g AS (SELECT kind, sign * count(*) / (count(*) - 1.0) AS z, sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22 FROM k GROUP BY kind, sign),
m AS (SELECT sum(z * m11) AS m11, sum(z * m12) AS m12, sum(z * m22) AS m22 FROM g),
h AS (SELECT *, i11 * m11 + i12 * m12 AS p11, i11 * m12 + i12 * m22 AS p12, i12 * m11 + i22 * m12 AS p21, i12 * m12 + i22 * m22 AS p22 FROM t, m),
v AS (SELECT b1, b2, p11 * i11 + p12 * i12 AS v11, p11 * i12 + p12 * i22 AS v12, p21 * i12 + p22 * i22 AS v22 FROM h)
SELECT 'n' AS term, round(b1, 6) AS value, round(sqrt(v11), 6) AS se FROM v UNION ALL SELECT 'log_amount', round(b2, 6), round(sqrt(v22), 6) FROM v
UNION ALL SELECT 'contrast', round(b1 + 2 * b2, 6), round(sqrt(v11 + 4 * v12 + 4 * v22), 6) FROM v
UNION ALL SELECT 'wald', round((b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12) / 2, 6), NULL FROM v"""


def _draw(k: int, *columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '1', '{k}', {', '.join(columns or ('id',))})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def _shock() -> str:
    return f"sqrt(-2 * ln({_draw(4, 's', 'week')} + 1e-12::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * {_draw(5, 's', 'week')})"


SIMULATED = f"""base AS (SELECT id, floor({_draw(1)} * 72)::INT AS partner, floor({_draw(2)} * 6)::INT AS s, {_draw(3)} AS t FROM range(20000) r(id)),
timed AS (SELECT *, floor(t * 730::DOUBLE * {DAY}::DOUBLE)::BIGINT AS u0 FROM base),
weekly AS (SELECT * EXCLUDE (u0), u0 AS first, u0 // {7 * DAY} AS week FROM timed),
moved AS (SELECT * EXCLUDE (week), first + CASE WHEN {_shock()} < 0 AND {_draw(6)} < 0.5 THEN {7 * DAY} ELSE 0 END AS u0 FROM weekly),
again AS (SELECT *, u0 // {7 * DAY} AS week FROM moved),
sim AS (SELECT s, u0, week, {_shock()} AS shock, ({_draw(8)} < {_draw(7, "partner")} * (0.4::DOUBLE + 0.6::DOUBLE * t))::INT AS template, ({_draw(32)} < 0.089::DOUBLE)::INT AS unfunded FROM again)"""

_PER_ROW = {
    "id is known": "id IS NULL", "sector is known": "sector IS NULL", "country is known": "country IS NULL", "activity is known": "activity IS NULL", "status is known": "status IS NULL",
    "split is complete": "year IS NULL", "no negative duration": "u1 < u0", "duration agrees with hours": "u1 - u0 <> hours * 3600000000", "amount is positive": "amount IS NULL OR amount <= 0",
    "outcome is finite": "ln(1 + hours) IS NULL OR isnan(ln(1 + hours))", "flag agrees with hours": "((hours <= 72)::INT = 1) <> (hours <= 72)", "weekday is 0 to 6": "weekday NOT BETWEEN 0 AND 6",
    "hour is 0 to 23": "hour NOT BETWEEN 0 AND 23", "gender is known": "gender NOT IN ('female', 'male')", "borrowers and term are positive": "borrowers < 1 OR term < 1", "pool is known": "n IS NULL",
    "pool is not negative": "n < 0", "pool is smaller than its sector": "n >= count(*) OVER (PARTITION BY sector)", "text is known": "words IS NULL OR words = 0",
}
GATES = f"""WITH {TEXTED}, p AS ({_pool(CURRENT, "").split(LOAN)[1]}),
w AS (SELECT loan.*, p.n, len(tokens) AS words FROM loan LEFT JOIN p ON p.id = loan.id LEFT JOIN texted ON texted.id = loan.id),
o AS (SELECT {", ".join(f"({c}) AS o{k}" for k, c in enumerate(_PER_ROW.values()))} FROM w)
""" + " UNION ALL ".join(f"SELECT '{name}' AS gate, count(*) FILTER (WHERE o{k}) = 0 AS passed, count(*) FILTER (WHERE o{k})::BIGINT AS offending FROM o" for k, name in enumerate(_PER_ROW)) + """
UNION ALL SELECT 'ids are unique', count(*) = 0, count(*)::BIGINT FROM (SELECT id FROM loan GROUP BY id HAVING count(*) > 1)"""


def _summary(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max FROM loan"


ORACLES = {
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "duplicate_ids": "SELECT l_orderkey AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "duration_quantiles": f"WITH {LOAN} SELECT " + ", ".join(f"round(quantile_cont(hours, {q})::DOUBLE, 6) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " FROM loan",
    "lag_gap_days": f"WITH {LOAN}, q AS (SELECT quantile_cont(hours, 0.95)::DOUBLE AS p FROM loan WHERE year <= 2000) SELECT round(p, 6) AS p95_hours, ceil(p / 24)::BIGINT AS gap_days FROM q",
    "negative_duration": """WITH r AS (SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT 0 AS step, 'all' AS stage, count(*)::BIGINT AS n FROM r UNION ALL SELECT 1, 'kept', count(*)::BIGINT FROM r WHERE l_shipdate >= o_orderdate""",
    "status_crosstab": f"WITH {LOAN} SELECT status, count(*) FILTER (WHERE u1 IS NOT NULL)::BIGINT AS raised, count(*) FILTER (WHERE u1 IS NULL)::BIGINT AS not_raised FROM loan GROUP BY status",
    "fast_funding_rate": f"WITH {LOAN} SELECT sector, count(*)::BIGINT AS n, round(avg((hours <= 72)::INT), 6) AS fast_share, round(avg(ln(1 + hours)), 6) AS mean_log_hours FROM loan GROUP BY sector",
    "sample_flow": f"""WITH {LOAN}, l AS (SELECT max(u0) AS a FROM loan), l2 AS (SELECT max(u0) AS a FROM loan WHERE year > 2000)
        SELECT 0 AS step, 'all' AS stage, count(*)::BIGINT AS n FROM loan UNION ALL SELECT 1, 'valid', count(*)::BIGINT FROM loan WHERE u1 >= u0
        UNION ALL SELECT 2, 'followed_72h', count(*)::BIGINT FROM loan, l WHERE u0 <= a - 72 * 3600000000
        UNION ALL SELECT 3, 'train', count(*)::BIGINT FROM loan WHERE year <= 2000 UNION ALL SELECT 4, 'holdout', count(*)::BIGINT FROM loan WHERE year > 2000
        UNION ALL SELECT 5, 'holdout_35d', count(*)::BIGINT FROM loan, l2 WHERE year > 2000 AND u0 <= a - 35 * {DAY}""",
    "median_by_year": f"WITH {LOAN} SELECT year::INT AS year, count(*)::BIGINT AS n, round(quantile_cont(hours, 0.5)::DOUBLE, 6) AS median_hours FROM loan GROUP BY year",
    "top_countries": f"WITH {LOAN} SELECT country, count(*)::BIGINT AS n FROM loan WHERE year <= 2000 GROUP BY country ORDER BY n DESC, country LIMIT 15",
    "eligible_sectors": f"WITH {LOAN} SELECT sector, count(*)::BIGINT AS n FROM loan WHERE year <= 2000 GROUP BY sector HAVING count(*) >= 2000",
    "data_profile": f"WITH {LOAN} {_summary('hours')} UNION ALL {_summary('amount')}",
    "calendar_parts": "SELECT (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, date_trunc('week', ts)::DATE::VARCHAR AS week, year(ts)::INT AS year, count(*)::BIGINT AS n FROM events GROUP BY ALL",
    "privacy_projection": f"WITH {LOAN} SELECT id, u0, hours, sector, year::INT AS year FROM loan",
    "structure_sample": f"WITH {LOAN} SELECT id, sector, country, hours FROM loan ORDER BY id LIMIT 100",
    "current_pool": _pool(CURRENT, ", round(ln(1 + count(s.id)), 6) AS c"),
    "recent_pool": _pool(RECENT, AGE),
    "completed_lag_pool": _pool(f"{RECENT} AND s.u1 <= f.u0", AGE),
    "mirror_pool_14d": _pool(f"s.u0 <= f.u0 AND f.u0 - s.u0 < {14 * DAY}", ""),
    "mirror_pool_16d": _pool(f"s.u0 <= f.u0 AND f.u0 - s.u0 < {16 * DAY}", ""),
    "min_pool_filter": f"WITH p AS ({_pool(CURRENT, '')}) SELECT count(*) FILTER (WHERE n >= 5)::BIGINT AS at_least_5, count(*) FILTER (WHERE n >= 20)::BIGINT AS at_least_20, count(*)::BIGINT AS n FROM p",
    "platform_pool": _pool(CURRENT, "", "true"),
    "platform_volume_7d": f"""WITH d AS (SELECT (epoch_us(ts) // {DAY})::BIGINT AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT a.day, any_value(a.n)::BIGINT AS n, sum(b.n)::BIGINT AS volume FROM d a JOIN d b ON b.day BETWEEN a.day - 6 AND a.day GROUP BY a.day""",
    "masked_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b', '<DATE>', 'g'),
        '[$€£]\s?\d[\d.,]*|\b\d[\d.,]*\s?(?:USD|EUR|GBP)\b', '<AMOUNT>', 'g'), '\b\d[\d.,]*\b', '<NUMBER>', 'g')) AS masked_md5 FROM documents""",
    "masked_names": r"""WITH t AS (
            SELECT c_custkey AS id, 'For ' || c_name || ' of ' || n_name || ', ' || lower(n_name) || ': ' || text AS text
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN documents ON doc_id = c_custkey % (SELECT count(*) FROM documents)
        ), w AS (SELECT id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS g FROM t),
        d AS (SELECT DISTINCT regexp_extract_all(lower(name), '[\p{L}\p{N}]+') AS d FROM (SELECT c_name AS name FROM customer UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)),
        n AS (SELECT DISTINCT len(d) AS n FROM d WHERE len(d) > 0), u AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        h AS (SELECT DISTINCT id, unnest(range(i, i + n)) AS p FROM u, n WHERE list_transform(w[i : i + n - 1], lambda x: lower(x)) IN (SELECT d FROM d)),
        r AS (SELECT w.id, k.i, g[k.i] AS gap, w.w[k.i] AS word, h.p IS NOT NULL AS hidden FROM w JOIN (SELECT id, unnest(range(1, len(w) + 2)) AS i FROM w) k ON k.id = w.id LEFT JOIN h ON h.id = w.id AND h.p = k.i),
        m AS (SELECT *, coalesce(lag(hidden) OVER (PARTITION BY id ORDER BY i), false) AS before FROM r)
        SELECT id, count(*) FILTER (WHERE hidden AND NOT before)::BIGINT AS n_names,
            md5(string_agg(CASE WHEN hidden AND before THEN '' WHEN hidden THEN gap || '<NAME>' ELSE gap || coalesce(word, '') END, '' ORDER BY i)) AS masked_md5 FROM m GROUP BY id""",
    "tfidf_terms": f"""WITH {DOCS}, tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM doc) GROUP BY ALL),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM doc)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
        x AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term))
        SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS w FROM x""",
    "bigram_df": f"WITH {DOCS}, g AS (SELECT DISTINCT id, array_to_string(tokens[i : i + 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM doc)) SELECT term, count(*)::BIGINT AS df FROM g GROUP BY term",
    "char_ngrams": "SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id AS id, substr(lower(text), i::BIGINT, 3) AS term FROM (SELECT *, unnest(range(1, length(text) - 1)) AS i FROM documents)) GROUP BY ALL",
    "recurring_phrases": f"WITH {PHRASES} SELECT * FROM phrases",
    "residual_text": f"""WITH {PHRASES}, cov AS (SELECT DISTINCT id, unnest(range(i, i + 5)) AS p FROM gram WHERE phrase IN (SELECT phrase FROM phrases)),
        w AS (SELECT id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS p FROM tok),
        k AS (SELECT w.id, count(*) AS n_left, string_agg(x, ' ' ORDER BY w.p) AS s FROM w LEFT JOIN cov ON cov.id = w.id AND cov.p = w.p WHERE cov.p IS NULL GROUP BY w.id)
        SELECT tok.id, coalesce(n_left, 0)::BIGINT AS n_left, md5(coalesce(s, '')) AS residual_md5 FROM tok LEFT JOIN k ON k.id = tok.id""",
    "public_ngrams": f"""WITH {DOCS}, g AS (SELECT DISTINCT id, unnest(tokens) AS term FROM doc UNION SELECT DISTINCT id, array_to_string(tokens[i : i + 1], ' ') FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM doc))
        SELECT term, count(*)::BIGINT AS df FROM g GROUP BY term HAVING count(*) >= 20""",
    "redacted_paths": r"""WITH l AS (
            SELECT 'pages' AS origin, page_id AS id, coalesce(html, '') AS t FROM pages UNION ALL SELECT 'events', event_id, coalesce(props, '') FROM events
        ), p AS (SELECT origin, id, t || CASE WHEN id % 3 = 0 THEN ' see "/home/user' || id::VARCHAR || '/notes.txt" and C:\Users\me\a.csv' ELSE '' END AS t FROM l),
        r AS (SELECT origin, id, regexp_replace(t, '(?:[A-Za-z]:\\Users\\|/home/|/Users/|/root/)[^\s"''<>|]*', '<PRIVATE_PATH>', 'g') AS t FROM p)
        SELECT origin, id, len(regexp_extract_all(t, '<PRIVATE_PATH>'))::BIGINT AS redactions, md5(t) AS line_md5 FROM r""",
    "hashed_terms": f"""WITH {DOCS}, g AS (SELECT id, unnest(tokens) AS term FROM doc UNION ALL SELECT id, array_to_string(tokens[i : i + 1], ' ') FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM doc))
        SELECT id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 131072)::INT AS bucket, count(*)::BIGINT AS tf FROM g GROUP BY ALL""",
    "focal_homogeneity_description": f"WITH {DESCRIBED}, {CUR} SELECT id, n, round(h, 6) AS h FROM cur",
    "recent_homogeneity_description": f"WITH {DESCRIBED}, {REC} SELECT id, n, round(v, 9) AS v, round(h, 6) AS h FROM rec",
    "homogeneity_audit": f"WITH {LOAN}, focal AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR), id) AS k FROM loan) " + " UNION ALL ".join(
        f"SELECT '{name}' AS pool, count(DISTINCT f.id)::BIGINT AS checks, true AS passed FROM focal f JOIN loan s ON f.sector = s.sector AND s.id <> f.id AND {condition} WHERE f.k <= {many}"
        for name, condition, many in (("current", CURRENT, 200), ("recent", RECENT, 200), ("mirror14d", f"s.u0 <= f.u0 AND f.u0 - s.u0 < {14 * DAY}", 200), ("description_current", CURRENT, 50), ("description_recent", RECENT, 50))
    ),
    "focal_homogeneity": f"WITH {TEXTED}, {CUR} SELECT id, n, round(h, 6) AS h FROM cur",
    "recent_homogeneity": f"WITH {TEXTED}, {REC} SELECT id, n, round(v, 9) AS v, round(h, 6) AS h FROM rec",
    "dense_mean_cosine": """WITH u AS (
            SELECT vec_id, label, list_transform(e, lambda v: v / n) AS u
            FROM (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, label, list_transform(embedding::FLOAT[], lambda v: v::DOUBLE) AS e FROM embeddings))
        ) SELECT a.vec_id, count(b.vec_id)::BIGINT AS n, round(avg(list_dot_product(a.u, b.u)), 6) AS h FROM u a LEFT JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id""",
    "zscore_interactions": f"WITH {MEASURES} SELECT id, round(z_c, 4) + 0.0 AS z_c, round(z_h, 4) + 0.0 AS z_h, round(z_v, 4) + 0.0 AS z_v, round(z_g, 4) + 0.0 AS z_g, round(z_c * z_h, 4) + 0.0 AS z_ch, round(z_v * z_g, 4) + 0.0 AS z_vg FROM z",
    "scenario_quantiles": f"WITH {MEASURES} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, round(quantile_cont({c}, 0.25), 6) AS low, round(quantile_cont({c}, 0.75), 6) AS high FROM m WHERE year <= 2000" for c in "chvg"),
    "support_count": f"WITH {MEASURES}, t AS (SELECT * FROM m WHERE year <= 2000) " + " UNION ALL ".join(
        f"""SELECT '{channel}' AS channel, '{end}' AS endpoint, count(*)::BIGINT AS n FROM t, (
            SELECT quantile_cont({x}, 0.25) AS x1, quantile_cont({x}, 0.75) AS x2, quantile_cont({y}, 0.25) AS y1, quantile_cont({y}, 0.75) AS y2 FROM t
        ) WHERE abs({x} - x{k}) <= 0.1 * (x2 - x1) AND abs({y} - y{k}) <= 0.1 * (y2 - y1)"""
        for channel, x, y in (("current", "c", "h"), ("recent", "v", "g")) for k, end in ((1, "low"), (2, "high"))
    ),
    "regime_by_year": f"WITH {MEASURES} SELECT year::INT AS year, count(*)::BIGINT AS n, round(avg(c), 6) AS mean_c, round(avg(h), 6) AS mean_h FROM m GROUP BY year",
    "fe_ols_gram": f"""WITH p AS ({_pool(CURRENT, ", any_value(f.hours) / 100.0 AS hours")}), r AS (SELECT 1.0 AS one, n::DOUBLE AS n, hours FROM p)
        """ + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a}::DOUBLE * {b}::DOUBLE), 3) AS s FROM r" for a, b in (("one", "one"), ("one", "n"), ("one", "hours"), ("n", "n"), ("n", "hours"), ("hours", "hours"))),
    "market_trigger": f"""WITH {MEASURES}, cell AS (SELECT sector, (u0 // {7 * DAY})::BIGINT AS week, avg(c * h) AS state, max((year <= 2000)::INT) AS train FROM m GROUP BY ALL HAVING avg(c * h) IS NOT NULL),
        q AS (SELECT quantile_cont(state, 0.75) AS b FROM cell WHERE train = 1)
        SELECT sector, week, round(state, 6) AS state, round(state, 6) > round(b, 6) AS flagged FROM cell, q""",
    "holdout_metrics": f"""WITH {FIXED}, a AS (SELECT avg(y) AS m FROM f35),
        r AS (SELECT p.prob AS pp, q.prob AS qp FROM f72 p JOIN f72 q ON p.fast = 1 AND q.fast = 0)
        SELECT 'r2' AS metric, round(1 - sum((y - pred) ** 2) / sum((y - m) ** 2), 6) AS value FROM f35, a
        UNION ALL SELECT 'mae_log', round(avg(abs(y - pred)), 6) FROM f35 UNION ALL SELECT 'rmse_log', round(sqrt(avg((y - pred) ** 2)), 6) FROM f35
        UNION ALL SELECT 'mae_hours', round(avg(abs((exp(y) - 1) - (exp(pred) - 1))), 6) FROM f35 UNION ALL SELECT 'brier', round(avg((prob - fast) ** 2), 6) FROM f72
        UNION ALL SELECT 'log_loss', round(avg(-(fast * ln(prob) + (1 - fast) * ln(1 - prob))), 6) FROM f72
        UNION ALL SELECT 'auc', round(avg(CASE WHEN pp > qp THEN 1.0 WHEN pp = qp THEN 0.5 ELSE 0.0 END), 6) FROM r""",
    "within_fit": WITHIN,
    "simulated_shares": f"""WITH {SIMULATED} SELECT u0 // {365 * DAY} AS period, round(avg(template), 6) AS templates, round(avg(unfunded), 6) AS unfunded FROM sim GROUP BY 1""",
    "shock_cells": f"""WITH {SIMULATED} SELECT 'sector' || s AS sector, week::INT AS week, count(*)::BIGINT AS n, round(avg(shock), 6) AS shock FROM sim GROUP BY ALL""",
    "qa_gates": GATES,
    "sensitive_content": r"""WITH l AS (SELECT translate(text, chr(10) || chr(13), '  ') || ' /home/user' || doc_id::VARCHAR || '/a.txt' AS t FROM documents),
        o AS (SELECT 'raw' AS output, t FROM l UNION ALL SELECT 'redacted', regexp_replace(t, '(?:[A-Za-z]:\\Users\\|/home/|/Users/|/root/)[^\s"''<>|]*', '<PRIVATE_PATH>', 'g') FROM l),
        h AS (
            SELECT output, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}') AS v FROM o
            UNION ALL SELECT output, 'private_path', regexp_extract_all(t, '(?:[A-Za-z]:\\Users\\|/home/|/Users/|/root/)[^\x00-\x20"''<>|]{0,999}') FROM o
            UNION ALL SELECT output, 'access_key', regexp_extract_all(t, 'AKIA[A-Z0-9]{16,64}') FROM o
            UNION ALL SELECT output, 'labelled_secret', regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?[:=]["'']?[A-Za-z0-9+/_.=-]{6,256}') FROM o
        ) SELECT output, kind, sum(len(v))::BIGINT AS hits, sum(list_sum(list_transform(v, lambda x: strlen(x))))::BIGINT AS bytes FROM h WHERE len(v) > 0 GROUP BY ALL""",
    "sink_round_trips": f"WITH {LOAN} " + " UNION ALL ".join(f"SELECT '{x}' AS sink, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids, sum(hours)::BIGINT AS hours, count(DISTINCT sector)::BIGINT AS sectors, max(year)::INT AS last_year FROM loan" for x in ("shards", "csv", "json")),
    "calibration": f"WITH {FIXED} " + " UNION ALL ".join(f"SELECT '{g}' AS dimension, {g} AS grp, count(*)::BIGINT AS n, round(avg(prob) - avg(fast), 6) AS gap FROM f72 GROUP BY {g}" for g in ("sector", "gender")),
}
