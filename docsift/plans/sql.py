"""The SQL that DuckDB checks the core's queries with, written by itself from the rules, not from the Spark plans."""

from __future__ import annotations

from docsift.config import Config, FieldSpec
from docsift.functions import regexes as R

RB = R.RE2_B
WS = R.JSWS
#: Letters that RE2 folds to ASCII ones where case doesn't count; elsewhere they are no letters of a pattern.
MATCH = "translate({0}, 'Kſ', '☒☒')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _collapsed(text: str = "text") -> str:
    return f"regexp_replace({text}, {q(WS + '+')}, ' ', 'g')"


LINES = f"""
raw AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS ord FROM documents WHERE text IS NOT NULL),
lines AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS line_no, line, {MATCH.format('line')} AS m
    FROM (SELECT doc_id, ord, trim({_collapsed('line')}) AS line FROM raw)
    WHERE line <> '' AND NOT regexp_matches(line, {q(R.PAGE_MARKER + '$')}))
"""


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def _scores(config: Config) -> dict[str, str]:
    t = f"coalesce({MATCH.format(_collapsed())}, '')"
    return {
        x.name: " + ".join([f"CASE WHEN {_has(t, '(?i)' + R.phrase(k, RB))} THEN {x.weight} ELSE 0 END" for k in x.keywords] or ["0"])
        for x in config.types
        if x.name != "Unknown"
    }


def _scored(config: Config) -> str:
    cols = ", ".join(f"({s})::INT AS score_{n.lower().replace(' ', '_')}" for n, s in _scores(config).items())
    return f"SELECT doc_id, {cols} FROM documents"


def _classified(config: Config) -> str:
    names = [n for n in _scores(config)]
    cols = [f"score_{n.lower().replace(' ', '_')}" for n in names]
    whens = " ".join(f"WHEN {c} = top THEN {q(n)}" for c, n in zip(cols, names, strict=True))
    return f"SELECT doc_id, CASE WHEN top <= 0 THEN 'Unknown' {whens} END AS document_type FROM (SELECT *, greatest({', '.join(cols)}) AS top FROM ({_scored(config)}))"


def _id(f: FieldSpec) -> str:
    t = MATCH.format(_collapsed())
    hits = ", ".join(f"nullif(upper(regexp_extract({t}, {q(R.labeled_id(x, RB, R.RE2_ID))}, 1)), '')" for x in f.labels)
    return f"SELECT doc_id, coalesce({hits}) AS value FROM documents"


def _amount_labeled(f: FieldSpec) -> str:
    hits = " UNION ALL ".join(
        f"SELECT doc_id, line_no, {k} AS k, regexp_extract(m, {q(R.labeled_amount(x, RB))}, 1) AS v FROM lines" for k, x in enumerate(f.labels)
    )
    return f"WITH {LINES}, hits AS ({hits}), best AS (SELECT doc_id, arg_max(v, line_no * 100 + k) AS value FROM hits WHERE v <> '' GROUP BY doc_id) SELECT doc_id, value FROM documents LEFT JOIN best USING (doc_id)"


def _amount_fallback() -> str:
    return f"""WITH {LINES}, found AS (SELECT doc_id, line_no, unnest(l) AS v, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, line_no, regexp_extract_all(m, {q(R.any_amount(RB))}, 1) AS l FROM lines)),
    ranked AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY replace(v, ',', '')::DOUBLE DESC, line_no, k) AS r FROM found)
    SELECT doc_id, v AS value FROM documents LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (doc_id)"""


def _any_date(text: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {q(p)}, 1), '')" for p in R.dates(RB)) + ")"


def _date_labeled(f: FieldSpec) -> str:
    label = "(?i)(?:" + "|".join(R.phrase(x, RB) for x in f.labels) + ")"
    return f"""WITH {LINES}, hits AS (SELECT doc_id, line_no, {_any_date('m')} AS v FROM lines WHERE {_has('m', label)}),
    best AS (SELECT doc_id, arg_min(v, line_no) AS value FROM hits WHERE v IS NOT NULL GROUP BY doc_id) SELECT doc_id, value FROM documents LEFT JOIN best USING (doc_id)"""


def _date_fallback() -> str:
    return f"WITH {LINES}, whole AS (SELECT doc_id, string_agg(m, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY doc_id) SELECT doc_id, {_any_date('t')} AS value FROM documents LEFT JOIN whole USING (doc_id)"


def _company() -> str:
    never, suffix = _has("m", R.words(R.NOT_COMPANY, RB)), _has("m", R.words(R.COMPANY_SUFFIX, RB))
    units = "(length(line) + length(regexp_replace(line, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
    title = f"{units} BETWEEN 4 AND 60 AND length(regexp_replace(line, '[^0-9]', '', 'g')) / {units} < 0.3 AND regexp_matches(line, '[A-Za-z]')"
    return f"""WITH {LINES}, ranked AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {suffix} THEN 0 ELSE 1 END, line_no) AS r
        FROM lines WHERE line_no <= 15 AND NOT {never} AND ({suffix} OR ({title})))
    SELECT doc_id, trim(regexp_replace(line, '[,;:]\\s*$', '')) AS value FROM documents LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (doc_id)"""


def _line_scores() -> str:
    yes = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    score = " + ".join([
        yes(_has("m", R.words(R.ADDRESS_HINT, RB)), 2), yes(_has("m", R.RE2_POSTAL), 2), yes("contains(m, ',')", 1),
        yes(_has("m", R.words(R.NOT_COMPANY, RB)), -3), yes(_has("m", R.words(R.COMPANY_SUFFIX, RB)), -3), yes(_has("m", R.KEY_VALUE), -4),
    ])
    return f"{LINES}, scored AS (SELECT doc_id, line_no, line, ({score})::INT AS score FROM lines WHERE line_no <= 25)"


def _address() -> str:
    windows = " UNION ALL ".join(
        f"SELECT a.doc_id, a.line_no AS s, {k} AS k, sum(b.score) AS score, string_agg(b.line, ', ' ORDER BY b.line_no) AS v FROM scored a JOIN scored b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + {k - 1} GROUP BY ALL HAVING count(*) = {k}"
        for k in range(1, 5)
    )
    return f"""WITH {_line_scores()}, windows AS ({windows}), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s, k) AS r FROM windows)
    SELECT doc_id, v AS value FROM documents LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND score >= 2) USING (doc_id)"""


# Documents of `analyzed` and their keys; the closure over documents that share a value.
DOCS = """
docs AS (SELECT DISTINCT doc_ix, file_name, source, document_type, nullif(doc_fields.document_number, '') AS dn, nullif(doc_fields.reference_number, '') AS rn FROM analyzed),
keys AS (SELECT doc_ix, 'documentNumber' AS field, dn AS value FROM docs WHERE dn IS NOT NULL UNION SELECT doc_ix, 'referenceNumber', rn FROM docs WHERE rn IS NOT NULL),
hubs AS (SELECT field, value, min(doc_ix) AS hub FROM keys GROUP BY ALL),
stars AS (SELECT field, value, hub, doc_ix FROM keys JOIN hubs USING (field, value) WHERE doc_ix <> hub),
links AS (SELECT hub AS a, doc_ix AS b FROM stars UNION SELECT doc_ix, hub FROM stars),
reach AS (SELECT doc_ix AS a, doc_ix AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
labels AS (SELECT a AS doc_ix, min(b) AS component FROM reach GROUP BY a),
placed AS (SELECT docs.*, component, count(*) OVER (PARTITION BY component) AS size FROM docs JOIN labels USING (doc_ix)),
kept AS (SELECT component, count(*) AS file_count, arg_min(dn, doc_ix) FILTER (dn IS NOT NULL) AS documentNumber, arg_min(rn, doc_ix) FILTER (rn IS NOT NULL) AS referenceNumber FROM placed WHERE size >= 2 GROUP BY component),
batched AS (SELECT *, 'BATCH-' || coalesce(documentNumber, referenceNumber) AS batch_id FROM kept),
alone AS (SELECT coalesce('documentNumber:' || dn, 'referenceNumber:' || rn, 'UNIDENTIFIED') AS key, doc_ix, file_name, document_type, source FROM placed WHERE size = 1)
"""
PIXELS = """
px AS (SELECT vec_id AS image_id, ((k - 1) // 8)::INT AS y, ((k - 1) % 8)::INT AS x, greatest(0, least(255, floor((v::DOUBLE + 1) * 127.5)))::INT AS gray
    FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),
hist AS (SELECT image_id, gray AS level, count(*) AS n FROM px GROUP BY ALL),
sums AS (SELECT *, (sum(n) OVER u)::DOUBLE AS dark, (sum(n * level) OVER u)::DOUBLE AS below, (sum(n) OVER w)::DOUBLE AS total, (sum(n * level) OVER w)::DOUBLE AS mass
    FROM hist WINDOW u AS (PARTITION BY image_id ORDER BY level ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY image_id)),
variance AS (SELECT *, CASE WHEN total - dark > 0 THEN dark * (total - dark) * (below / dark - (mass - below) / (total - dark)) * (below / dark - (mass - below) / (total - dark)) ELSE 0 END AS b FROM sums),
otsu AS (SELECT image_id, CASE WHEN b > 0 THEN level ELSE 0 END::INT AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, level) AS r FROM variance) WHERE r = 1)
"""


# The closed form of what the documents rendered from an order hold (docsift.plans.render).
ORDERS = """
o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%d/%m/%Y') AS day, format('{:,.2f}', o_totalprice) AS price, c_name || ' Pvt Ltd' AS buyer,
    o_custkey || ' Market Street, ' || n_name || ' ' || (400000 + o_custkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def statements(config: Config) -> dict[str, str]:
    fields = {f.name: f for f in config.fields}
    merge = lambda a, b: f"SELECT doc_id, coalesce(a.value, b.value) AS value FROM ({a}) a JOIN ({b}) b USING (doc_id)"
    values = {
        "documentNumber": _id(fields["documentNumber"]), "referenceNumber": _id(fields["referenceNumber"]), "companyName": _company(), "address": _address(),
        "date": merge(_date_labeled(fields["date"]), _date_fallback()), "amount": merge(_amount_labeled(fields["amount"]), _amount_fallback()),
    }
    masked = ", ".join(f"CASE WHEN document_type IN ({', '.join(map(q, fields[n].applies_to))}) THEN v_{n}.value END AS \"{n}\"" for n in values)
    joins = " ".join(f"JOIN ({s}) v_{n} USING (doc_id)" for n, s in values.items())
    batch = lambda select: f"WITH RECURSIVE {DOCS} {select}"
    t = MATCH.format(_collapsed())
    level = lambda k: f"greatest(0, least(255, floor((embedding[p + {k + 1}]::DOUBLE + 1) * 127.5)))::INT"
    return {
        "collapse_ws": f"SELECT doc_id, {_collapsed()} AS collapsed FROM documents",
        "split_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
        "alnum_count": "SELECT doc_id, coalesce(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), 0) AS alnum FROM documents",
        "phrase_match": f"SELECT doc_id, {_has(t, '(?i)' + R.phrase('Invoice No', RB))} AS invoice_no, {_has(t, '(?i)' + R.phrase('P.O.', RB))} AS p_o, {_has(t, '(?i)' + R.phrase('Inv #', RB))} AS inv FROM documents",
        "ocr_route": """SELECT doc_id, CASE WHEN coalesce(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), 0) BETWEEN 1 AND 24 THEN 'ocr' ELSE 'text' END AS source, coalesce(length(text), 0) AS n FROM documents""",
        "page_concat": "SELECT file_name, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_ix, text), '') AS text FROM (SELECT DISTINCT file_name, doc_ix, text FROM doc_text) GROUP BY file_name",
        "keyword_scores": _scored(config),
        "classify": _classified(config),
        "analyze": f"SELECT doc_id, document_type, {masked} FROM ({_classified(config)}) {joins}",
        "extract_document_number": values["documentNumber"],
        "extract_reference_number": values["referenceNumber"],
        "extract_amount_labeled": _amount_labeled(fields["amount"]),
        "extract_amount_fallback": _amount_fallback(),
        "extract_amount": values["amount"],
        "extract_date_labeled": _date_labeled(fields["date"]),
        "extract_date_fallback": _date_fallback(),
        "extract_date": values["date"],
        "extract_company": values["companyName"],
        "address_line_score": f"WITH {_line_scores()} SELECT doc_id, line_no, score FROM scored",
        "extract_address": values["address"],
        "linkage_edges": batch("SELECT field, value, hub, doc_ix FROM stars"),
        "batch_components": batch("SELECT doc_ix, component FROM labels"),
        "batches": batch("SELECT component, batch_id, documentNumber, referenceNumber, file_count FROM batched"),
        "batch_members": batch("SELECT component, batch_id, doc_ix, file_name, document_type, source FROM placed JOIN batched USING (component)"),
        "rendered_analyze": f"""WITH {ORDERS}
            SELECT 4 * k AS doc_ix, 'Purchase Order' AS document_type, NULL::VARCHAR AS "documentNumber", 'PO-' || k AS "referenceNumber", buyer AS "companyName", place AS address, day AS date, NULL::VARCHAR AS amount FROM o WHERE k % 5 <> 0
            UNION ALL SELECT 4 * k + 1, 'Invoice', 'INV-' || k, 'PO-' || k, buyer, place, day, price FROM o
            UNION ALL SELECT 4 * k + 2, 'Receipt', 'INV-' || k, NULL, 'Zenith Retail LLP', NULL, day, price FROM o WHERE k % 3 = 0
            UNION ALL SELECT 4 * k + 3, 'Unknown', NULL, NULL, NULL, NULL, NULL, NULL FROM o WHERE k % 10 = 0""",
        "rendered_batches": """SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 4 * o_orderkey ELSE 4 * o_orderkey + 1 END AS component, 'BATCH-INV-' || o_orderkey AS batch_id, 'INV-' || o_orderkey AS "documentNumber", 'PO-' || o_orderkey AS "referenceNumber",
            1 + (o_orderkey % 5 <> 0)::BIGINT + (o_orderkey % 3 = 0)::BIGINT AS file_count FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0""",
        "rendered_unbatched": """SELECT 'documentNumber:INV-' || o_orderkey AS key, 4 * o_orderkey + 1 AS doc_ix, 'Invoice' AS document_type FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
            UNION ALL SELECT 'UNIDENTIFIED', 4 * o_orderkey + 3, 'Unknown' FROM orders WHERE o_orderkey % 10 = 0""",
        "batch_key_values": batch("SELECT component, file_count, documentNumber, referenceNumber FROM kept"),
        "batch_conflicts": batch("""SELECT component, 'documentNumber' AS field, documentNumber AS kept, dn AS other, doc_ix FROM placed JOIN kept USING (component) WHERE dn <> documentNumber
            UNION ALL SELECT component, 'referenceNumber', referenceNumber, rn, doc_ix FROM placed JOIN kept USING (component) WHERE rn <> referenceNumber"""),
        "batch_report_map": batch("SELECT batch_id, max(component) AS component, arg_max(file_count, component) AS file_count FROM batched GROUP BY batch_id"),
        "unbatched": batch("SELECT key, doc_ix, file_name, document_type, source FROM alone"),
        "report_summary": batch("""SELECT (SELECT count(*) FROM docs) + (SELECT count(*) FROM doc_errors) AS total_pdfs, (SELECT count(*) FROM docs) AS analyzed, (SELECT count(*) FROM docs WHERE source = 'ocr') AS ocr_used,
            (SELECT count(*) FROM doc_errors) AS failed, (SELECT count(DISTINCT batch_id) FROM batched) AS batches, (SELECT count(DISTINCT key) FROM alone) AS unbatched_groups"""),
        "grayscale": f"SELECT image_id, x, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5)::INT AS gray FROM (SELECT vec_id AS image_id, p::INT AS x, {level(0)} AS r, {level(1)} AS g, {level(2)} AS b FROM embeddings, range(62) t(p))",
        "median3x3": f"WITH {PIXELS} SELECT a.image_id, a.y, a.x, CASE WHEN count(*) = 9 THEN list_sort(list(b.gray))[5] ELSE any_value(a.gray) END AS gray FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x",
        "gray_histogram": f"WITH {PIXELS} SELECT image_id, level, n FROM hist",
        "otsu_threshold": f"WITH {PIXELS} SELECT image_id, threshold FROM otsu",
        "binarize": f"WITH {PIXELS} SELECT image_id, y, x, CASE WHEN gray > threshold THEN 255 ELSE 0 END::INT AS gray FROM px JOIN otsu USING (image_id)",
        "upload_guard": "SELECT doc_id, doc_id % 3 = 0 AND coalesce(length(text), 0) * 40000 <= 26214400 AS accepted, CASE WHEN doc_id % 3 <> 0 THEN 'type' WHEN length(text) * 40000 > 26214400 THEN 'size' END AS problem FROM documents",
        "upload_dedup": "SELECT file_name, length(file_name)::INT AS size, min(doc_ix) AS doc_ix FROM analyzed GROUP BY file_name",
        "type_hue": """SELECT document_type, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(document_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 360 AS hue FROM (SELECT DISTINCT document_type FROM analyzed)""",
        "fields_summary": "SELECT DISTINCT doc_ix, concat_ws(' · ', 'number: ' || doc_fields.document_number, 'reference: ' || doc_fields.reference_number, 'company: ' || doc_fields.company_name, 'address: ' || doc_fields.address, 'date: ' || doc_fields.doc_date, 'amount: ' || doc_fields.amount) AS summary FROM analyzed",
        "upload_requests": """SELECT request, files, problem IS NULL AS accepted, problem FROM (SELECT vendor_key AS request, count(*) AS files, CASE WHEN count(*) > 200 THEN 'count' WHEN count(*) FILTER (doc_id % 2 = 1 AND doc_id % 7 = 0) > 0 THEN 'type'
            WHEN max(coalesce(n_chars, 0)) * 10000 > 26214400 THEN 'size' END AS problem FROM documents GROUP BY vendor_key)""",
        "human_bytes": """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KB', floor(n / 1024 * 10 + 0.5) / 10) ELSE format('{:.1f} MB', floor(n / 1048576 * 10 + 0.5) / 10) END AS size FROM (SELECT doc_id, coalesce(n_chars, 0) * 1000 AS n FROM documents)""",
        "error_isolation": """SELECT outcome, count(*) AS n FROM (
            SELECT CASE WHEN length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 25 THEN 'text' ELSE 'no engine for recognition is registered' END AS outcome FROM (SELECT DISTINCT doc_ix, file_name, text FROM doc_text WHERE text IS NOT NULL)
            UNION ALL SELECT CASE WHEN reason IN ('Password required', 'Invalid PDF structure') THEN reason ELSE 'no engine for recognition is registered' END FROM doc_errors) GROUP BY outcome""",
    }
