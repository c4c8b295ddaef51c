"""DuckDB SQL for the queries of this folder that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

#: crc32 of a text in SQL: TABLE has the 256 remainders as a list, crc() goes on from byte to byte.
CRC_TABLE = """crctab AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8; needs crctab in FROM."""
    codes = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda p: ('0x' || substr(hex(encode({text})), p, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs are numbered by distinct document and run, so that a checksum is taken once; variants by one deleted or masked code point bring near words together.
VARIANTS = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
summed AS (SELECT run, k, {_crc("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crctab),
spelled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM summed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
masked AS (SELECT word, n, unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || '?' || substr(word, i + 1)))) AS v FROM words),
cut AS (SELECT DISTINCT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS v FROM words),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM masked a JOIN masked b ON a.v = b.v AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.v UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.v),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS best, max(m) AS m FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN best END AS form, CASE WHEN m >= 10 * w.n THEN m END::BIGINT AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root, 0 AS d FROM formed UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word) c ON c.word = f.word"""

_STOP = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which you la le les de des du et un une est que qui dans pour pas sur au en il elle ce ne der die das und ist von den mit zu dem des ein eine nicht auch auf für im sich es el los las una y por con no su para como más pero al lo se del"
_W = r"\x20\x09-\x0D"
RULES = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_W}]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_W}]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE (doc_id, k) IN (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1)) GROUP BY doc_id),
c AS (
    SELECT a.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha,
        len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}]+'), lambda x: x IN ({", ".join(f"'{x}'" for x in sorted(set(_STOP.split())))}))) AS n_stop,
        length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals, len(l) AS n_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[{_W}]*[\x{{2022}}\x{{2023}}*\x{{B7}}-]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[{_W}]*$'))) AS cut
    FROM a LEFT JOIN r ON r.doc_id = a.doc_id
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
    AND coalesce(word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND n_alpha / n_words >= 0.7 AND n_stop / n_words >= 0.05, true)
    AND (letters = 0 OR capitals / letters <= 0.5) AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3 AND bullets / n_lines <= 0.9 AND cut / n_lines <= 0.3) AS kept FROM b"""

_HOUR = 3_600_000_000
#: What a stream writes, from the batches alone: the first in which a pane is due, and closed.
PANES = f"""WITH {CRC_TABLE},
once AS (SELECT DISTINCT ON (click_id) click_id, epoch_us(ts) AS ts, epoch_us(coalesce(arrived_at, ts)) // {24 * _HOUR} AS d, coalesce(kind, 'none') AS kind, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents
    FROM clicks WHERE ts IS NOT NULL ORDER BY click_id, arrived_at NULLS FIRST, ts, kind NULLS FIRST, value NULLS FIRST),
e AS (SELECT click_id, kind, cents, least(7, d % 8 + greatest(0, {_crc("click_id::VARCHAR")} % 30 - 23))::BIGINT AS batch, ts - (d - d % 8) * {24 * _HOUR} AS event FROM once, crctab),
x AS (SELECT *, floor(event / {_HOUR}.0)::BIGINT AS hour FROM e),
b AS (SELECT range AS batch, (SELECT max(event) FROM x WHERE x.batch < range) AS w FROM range(8)),
p AS (SELECT hour, kind, (SELECT min(batch) FROM b WHERE w >= (hour + 7) * {_HOUR}) AS due, (SELECT min(batch) FROM b WHERE w >= (hour + 97) * {_HOUR}) AS closed FROM (SELECT DISTINCT hour, kind FROM x)),
y AS (SELECT x.*, due, closed, coalesce(batch >= closed, false) AS late FROM x JOIN p ON p.hour = x.hour AND p.kind = x.kind),
s AS (SELECT hour, kind, batch, any_value(due) AS due, count(*) AS n, sum(cents) AS c FROM y WHERE NOT late GROUP BY ALL),
v AS (SELECT *, sum(n) OVER o AS tn, sum(c) OVER o AS tc, min(batch) OVER (PARTITION BY hour, kind) AS first FROM s WINDOW o AS (PARTITION BY hour, kind ORDER BY batch)),
z AS (SELECT *, CASE WHEN due IS NOT NULL THEN greatest(due, first) END AS emitted FROM v)
SELECT batch, hour, click_id, 1::BIGINT AS n_rows, cents, 'late' AS record, kind FROM y WHERE late
UNION ALL SELECT any_value(emitted)::BIGINT, hour, -1::BIGINT, sum(n)::BIGINT, sum(c)::BIGINT, 'emit', kind FROM z WHERE batch <= emitted GROUP BY hour, kind
UNION ALL SELECT batch, hour, -1, (tn - n)::BIGINT, (tc - c)::BIGINT, 'retract', kind FROM z WHERE batch > emitted
UNION ALL SELECT batch, hour, -1, tn::BIGINT, tc::BIGINT, 'replace', kind FROM z WHERE batch > emitted
UNION ALL SELECT 7, hour, -1, sum(n)::BIGINT, sum(c)::BIGINT, 'final', kind FROM z WHERE due IS NULL GROUP BY hour, kind"""

ORACLES = {
    "op9_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], chr(31)) AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
        r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o),
        k AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
        SELECT k.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, k.doc_id = component_id AS kept FROM k LEFT JOIN n ON n.doc_id = k.doc_id
    """,
    "op10_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
        r AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
        c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g WHERE s IN (SELECT s FROM r)) GROUP BY doc_id),
        k AS (
            SELECT doc_id, list(x ORDER BY p) AS kept
            FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) t
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ps) AS p FROM c) u WHERE u.doc_id = t.doc_id AND u.p = t.p)
            GROUP BY doc_id
        )
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
    """,
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(range(len(ls))) AS p, unnest(ls) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
        ), k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        d AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone FROM k LEFT JOIN c ON c.key = k.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """,
    "op3_benchmark_decontamination": rf"""
        WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        w AS (SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM t),
        s AS (
            SELECT DISTINCT k, id, array_to_string(ws[i : i + 4], chr(31)) AS g
            FROM (SELECT k, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
        ), n AS (SELECT id, count(*) AS n FROM s WHERE k = 'b' GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, any_value(n.n)::BIGINT AS n_item
        FROM s d JOIN s b ON d.g = b.g AND d.k = 'd' AND b.k = 'b' JOIN n ON n.id = b.id
        GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n.n)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
        d AS (
            SELECT page_id, payload_bytes, array_to_string([
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)
            ], '') AS payload_digest FROM h
        ), f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM d GROUP BY ALL)
        SELECT page_id, d.payload_bytes::BIGINT AS payload_bytes, d.payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d JOIN f USING (payload_digest, payload_bytes)
    """,
    "op6_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), t AS (
            SELECT *, length(text) + length(regexp_replace(text, '[^\\<>\[\]]', '', 'g')) AS n, length(role) + length(regexp_replace(role, '[^\\<>\[\]]', '', 'g')) AS m FROM c
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 11 + m END)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op11_spelling_variants": VARIANTS,
    "op12_quality_rules": RULES,
    "op13_window_panes": PANES,
}
