"""DuckDB SQL for the registered queries, written from the rules, and further tables that both sides read."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.operators import form, matchers
from vouch.plans import stand_ins as S

LICENCE_ANCHORS = ("licensedunder", "apachelicense", "version20")

#: Each option's box in pixels, and the share of its pixels that are dark.
RATIOS = f"""
SELECT app_id, option, option_pos, avg(CASE WHEN {S.dark_pixel('x', 'y')} THEN 1.0 ELSE 0.0 END) AS dark_ratio FROM (
  SELECT *, unnest(range(y0, y1)) AS y FROM (
    SELECT *, unnest(range(x0, x1)) AS x FROM (
      SELECT app_id, option, option_pos, greatest(0, CAST(floor((e.x - 14) * 1.5 + 0.5) AS BIGINT)) AS x0, least(24, CAST(floor((e.x - 6) * 1.5 + 0.5) AS BIGINT)) AS x1,
        greatest(0, CAST(floor((e.y - 3) * 1.5 + 0.5) AS BIGINT)) AS y0, least(84, CAST(floor((e.y + 5) * 1.5 + 0.5) AS BIGINT)) AS y1, p_partkey, p_size FROM (
        SELECT app_id, option, option_pos, arg_max({{'x': x1, 'y': y1}}, line_pos) AS e FROM ({S.OPTION_LINES.strip()}) l
        JOIN (VALUES ('WINE', 'WINE', 0), ('DISTILLED SPIRITS', 'DISTILLED SPIRITS', 1), ('MALT BEVERAGE', 'MALT BEVERAGE', 2), ('MALT BEVERAGES', 'MALT BEVERAGE', 2)) o(shown, option, option_pos) ON trim(text) = shown GROUP BY 1, 2, 3
      ) JOIN part ON p_partkey = app_id))) GROUP BY 1, 2, 3
"""
PAGE_LINES = """
SELECT p_partkey AS app_id, 0 AS line_pos, '  1. REP. ID. NO. (If any)' AS text, 10.5 AS x1, CAST(p_size AS DOUBLE) AS y1, 200.25 AS x2, CAST(p_size + 10 AS DOUBLE) AS y2 FROM {part}
UNION ALL SELECT p_partkey, 1, '6. BRAND NAME (Required)', 11.5, CAST(p_size + 20 AS DOUBLE), 201.0, CAST(p_size + 30 AS DOUBLE) FROM {part} WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 2, '6. BRAND NAME (Required)', 12.5, CAST(p_size + 40 AS DOUBLE), 202.0, CAST(p_size + 50 AS DOUBLE) FROM {part}
UNION ALL SELECT p_partkey, 3, 'no question', 1.0, 2.0, 3.0, 4.0 FROM {part}
"""
SIZED = "SELECT p_partkey AS app_id, 'p2_1.png' AS name, CAST(p_size * 70 AS INT) AS width, CAST(p_partkey % 900 + 50 AS INT) AS height FROM {part}"
NAMED_IMAGES = """
SELECT p_partkey AS app_id, 'p2_2.png' AS name FROM {part} UNION ALL SELECT p_partkey, 'p2_10.png' FROM {part}
UNION ALL SELECT p_partkey, concat('p', CAST(p_size AS STRING), '_1.png') FROM {part} WHERE p_size <> 2
UNION ALL SELECT p_partkey, 'p1_1.jpg' FROM {part} UNION ALL SELECT p_partkey, 'xp1_1.png' FROM {part}
"""
#: Characters of a part's name with a gap after every third.
CHARS = " UNION ALL ".join(
    f"SELECT p_partkey AS app_id, 1 AS page, 0 AS line, {i} AS seq, substr(p_name, {i + 1}, 1) AS c, CAST({10 * i + (i // 3) * 4} AS DOUBLE) AS x0, CAST({10 * i + 10 + (i // 3) * 4} AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y0, CAST(10 + p_size AS DOUBLE) AS y1 FROM {{part}} WHERE length(p_name) > {i}"
    for i in range(12)
)


def drawn_images(spark, d):
    """app_id, name, w, h, pixels: 32 by 24 pixels of two shades by part."""
    part = S.table(spark, d, "part")
    row = F.concat(F.repeat(F.lit("40"), (F.col("p_size") % 20).cast("int")), F.repeat(F.lit("D0"), 32 - (F.col("p_size") % 20).cast("int")))
    return part.select(F.col("p_partkey").alias("app_id"), F.lit("p2_1.png").alias("name"), F.lit(32).alias("w"), F.lit(24).alias("h"), F.unhex(F.repeat(row, 24)).alias("pixels"))


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{name} AS ({S.for_duckdb(sql)})" for name, sql in ctes) + " "


# --- documents as labels ------------------------------------------------------------------------------------------

_SPLIT = ("split", "SELECT doc_id AS app_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_pos FROM documents")
_DOC_LINES = ("lines", "SELECT app_id, CAST(line_pos % 2 AS INT) AS img_pos, concat('p1_', CAST(line_pos % 2 + 1 AS STRING), '.png') AS image, CAST(line_pos AS INT) AS line_pos, text FROM split WHERE trim(text, chr(32) || chr(9) || chr(13) || chr(10)) <> ''")
_DOC_CORPUS = ("corpus", f"SELECT *, replace(nl, ' ', '') AS nlc, img_pos * 4294967296 + line_pos AS ord FROM (SELECT *, {T.norm_sql('text')} AS nl FROM lines)")

_FIRST = _with(
    _SPLIT, _DOC_LINES, _DOC_CORPUS,
    ("named", "SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS w FROM documents"),
    ("probes", f"SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id - 1 END AS app_id, doc_id AS pos, {T.norm_sql("concat_ws(' ', w[2], w[3])")} AS a FROM named"),
    ("hits", "SELECT p.app_id, p.pos, arg_min({'image': image, 'line': text}, ord) AS e FROM probes p JOIN corpus c ON p.app_id = c.app_id AND p.a <> '' AND contains(c.nl, p.a) GROUP BY 1, 2"),
)

# --- forms --------------------------------------------------------------------------------------------------------

_FURNITURE, _CONTINUATION = (T.quoted(p) for p in (form.FURNITURE, form.CONTINUATION))
_PAGES = ("pages", S.PAGES)
_FORM = (
    _PAGES,
    ("raw", "SELECT app_id, unnest(string_split(text, chr(10))) AS r, generate_subscripts(string_split(text, chr(10)), 1) AS line_pos FROM pages WHERE page = 1"),
    ("cleaned", "SELECT app_id, line_pos, trim(r, chr(32) || chr(9) || chr(13) || chr(10)) AS s FROM raw"),
    ("marked", f"SELECT *, regexp_matches(s, {T.quoted(form.STOP)}) AS stop, regexp_extract(s, {T.quoted(form.QUESTION)}, 1) AS num FROM cleaned WHERE s <> '' AND NOT regexp_matches(s, {_FURNITURE}) AND NOT regexp_matches(s, {_CONTINUATION})"),
    ("numbered", "SELECT *, sum(CASE WHEN stop OR num <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY app_id ORDER BY line_pos) AS island FROM marked"),
    ("opened", "SELECT *, first_value(stop) OVER w AS stopped, first_value(num) OVER w AS first_num, first_value(s) OVER w AS head, row_number() OVER w AS k FROM numbered WHERE island > 0 WINDOW w AS (PARTITION BY app_id, island ORDER BY line_pos)"),
    ("prompted", f"SELECT *, CASE WHEN NOT contains({T.ascii_lower_sql('head')}, 'name and address') THEN 1 ELSE coalesce(min(CASE WHEN contains(s, '(Required)') THEN k END) OVER (PARTITION BY app_id, island), 1000000) END AS upto FROM opened WHERE NOT stopped"),
    ("folded", "SELECT app_id, island, first_num AS num, string_agg(CASE WHEN k <= upto THEN s END, ' ' ORDER BY k) AS question, coalesce(string_agg(CASE WHEN k > upto THEN s END, ' ' ORDER BY k), '') AS answer FROM prompted GROUP BY app_id, island, first_num"),
    ("form", "SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY island) - 1 AS INT) AS pos, num, question, answer FROM folded"),
)
_PRODUCTS = ("ratios", RATIOS), (
    "products",
    "SELECT app_id, CASE WHEN dark >= 0.30 AND dark - coalesce(second, 0) >= 0.10 THEN option ELSE '' END AS product FROM (SELECT app_id, max(CASE WHEN place = 1 THEN option END) AS option, max(CASE WHEN place = 1 THEN dark_ratio END) AS dark, max(CASE WHEN place = 2 THEN dark_ratio END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY dark_ratio DESC, option_pos) AS place FROM ratios) GROUP BY app_id)",
)
_KIND = T.field_kind_sql("question")
_TRIMMED = "trim({0}, chr(32) || chr(9) || chr(13) || chr(10))"
_BOXES = (
    ("plines", PAGE_LINES),
    ("boxes", f"SELECT *, row_number() OVER (PARTITION BY app_id, num ORDER BY line_pos) AS k FROM (SELECT *, regexp_extract({_TRIMMED.format('text')}, {T.quoted(form.QUESTION)}, 1) AS num FROM plines) WHERE num <> ''"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY app_id, num ORDER BY pos) AS k FROM form"),
    ("boxed_form", "SELECT r.app_id, r.pos, r.num, r.question, r.answer, " + ", ".join(f"CAST(b.{c} * 1.5 AS FLOAT) AS bbox_{c}" for c in form.BOX) + " FROM ranked r LEFT JOIN boxes b ON r.app_id = b.app_id AND r.num = b.num AND r.k = b.k"),
)
_AT = "{'value': %s, " + ", ".join(f"'{c}': CAST({c} * 1.5 AS FLOAT)" for c in form.BOX) + "}"
_WIDGETS = (
    ("widgets", S.WIDGETS),
    ("filled", f"SELECT * REPLACE ({_TRIMMED.format('value')} AS value), {T.field_kind_sql('name')} AS kind FROM widgets WHERE name <> '' AND {_TRIMMED.format('value')} NOT IN ('', 'Off', '/Off')"),
    ("product", "SELECT *, CASE WHEN contains(lower(value), 'wine') THEN 'WINE' WHEN contains(lower(value), 'spirit') THEN 'DISTILLED SPIRITS' ELSE 'MALT BEVERAGE' END AS product FROM filled WHERE name = 'Check Box22' AND regexp_matches(lower(value), 'wine|spirit|malt')"),
    ("boxed", f"SELECT app_id, arg_min({_AT % 'product'}, seq) AS a, 'ProductType' AS kind, NULL AS name, 0 AS seq FROM product GROUP BY app_id"),
    ("named", f"SELECT app_id, arg_max({_AT % 'value'}, seq) AS a, kind, arg_min(name, seq) AS name, min(seq) AS seq FROM filled WHERE kind NOT IN ('Admin', 'ProductType') GROUP BY app_id, kind"),
    ("wanted", "SELECT * FROM boxed UNION ALL SELECT * FROM named"),
    ("own", f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY app_id, {_KIND} ORDER BY pos) = 1 THEN {_KIND} END AS kind FROM boxed_form"),
    ("joined", "SELECT coalesce(o.app_id, w.app_id) AS app_id, o.* EXCLUDE (app_id, kind), w.seq, w.name, w.a FROM own o FULL OUTER JOIN wanted w ON o.app_id = w.app_id AND o.kind = w.kind WHERE o.pos IS NOT NULL OR w.name IS NOT NULL"),
    (
        "over",
        f"SELECT app_id, pos, seq, coalesce(num, regexp_extract(name, {T.quoted(form.QUESTION)}, 1), '') AS num, coalesce(question, name) AS question, CASE WHEN a IS NULL THEN answer ELSE a.value END AS answer, a IS NOT NULL AS from_widget, "
        + ", ".join(f"CASE WHEN a IS NULL THEN bbox_{c} ELSE a.{c} END AS bbox_{c}" for c in form.BOX)
        + ", bool_or(a IS NOT NULL) OVER (PARTITION BY app_id) AS applied FROM joined",
    ),
)

# --- verdicts -----------------------------------------------------------------------------------------------------

_CORPUS = (("lines", S.LABEL_LINES), ("corpus", f"SELECT *, replace(nl, ' ', '') AS nlc, img_pos * 4294967296 + line_pos AS ord FROM (SELECT *, {T.norm_sql('text')} AS nl FROM lines)"))
_ASKED = ("asked", f"SELECT *, {T.norm_sql('answer')} AS a, regexp_extract(answer, {T.quoted(T.NUMBER)}, 1) AS number, {_KIND} AS kind FROM (SELECT app_id, pos, num, question, trim(answer, chr(32) || chr(9) || chr(13) || chr(10)) AS answer FROM form) WHERE answer <> ''")
_E = "{'image': image, 'line': text, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_STEP = 18014398509481984


def _lookup(probes: str, *ways: str) -> str:
    """The first line of each probe over its ways, best first."""
    rank = "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, w in enumerate(ways)) + " END"
    held = " OR ".join(f"({w})" for w in ways)
    return f"SELECT p.app_id, p.pos, min((p.rank * {len(ways)} + {rank}) * {_STEP} + c.ord) // {_STEP} AS way, arg_min({_E}, (p.rank * {len(ways)} + {rank}) * {_STEP} + c.ord) AS e FROM {probes} p JOIN corpus c ON p.app_id = c.app_id AND ({held}) GROUP BY 1, 2"


def _rows(asked: str, found: str, status: str, note: str = "''", matched_as: str = "CAST(NULL AS VARCHAR)", found_n: str = "CAST(NULL AS BIGINT)", of_n: str = "CAST(NULL AS BIGINT)") -> str:
    return f"""SELECT q.app_id, q.pos, q.num, q.question, q.answer, {status} AS status, f.e IS NOT NULL AS found, coalesce(f.e.image, '') AS image, coalesce(f.e.line, '') AS line,
      coalesce(f.e.conf, -1.0) AS conf, CAST({found_n} AS BIGINT) AS found_n, CAST({of_n} AS BIGINT) AS of_n, coalesce(f.e.x1, 0) AS line_x1, coalesce(f.e.y1, 0) AS line_y1, coalesce(f.e.x2, 0) AS line_x2, coalesce(f.e.y2, 0) AS line_y2,
      {note} AS note, false AS mandatory, '' AS mandatory_message, {matched_as} AS matched_as
      FROM {asked} q LEFT JOIN {found} f ON q.app_id = f.app_id AND q.pos = f.pos"""


_HIT = "CASE WHEN f.e IS NOT NULL THEN 'MATCH' ELSE 'NOT FOUND' END"
_NAME = "regexp_replace(array_to_string(list_slice(w, len(w) - n + 1, len(w)), ' '), '[,.]+$', '')"
_NOWHERE = "{'image': 'multiple', 'line': words, 'conf': CAST(-1 AS DOUBLE), 'x1': 0, 'y1': 0, 'x2': 0, 'y2': 0}"


def _coverage(toks: str) -> str:
    return f"SELECT app_id, pos, count(*) AS of_n, count(*) FILTER (held) AS found_n, coalesce(string_agg(CASE WHEN held THEN token END, ' ' ORDER BY i), '') AS words FROM (SELECT *, EXISTS (SELECT 1 FROM corpus c WHERE c.app_id = t.app_id AND contains(c.nl, t.token)) AS held FROM {toks} t) GROUP BY 1, 2"


def _words_of(least: int, source: str) -> str:
    toks = f"list_filter(string_split(a, ' '), lambda t: length(t) >= {least} AND t <> '')"
    return f"SELECT app_id, pos, unnest({toks}) AS token, generate_subscripts({toks}, 1) AS i FROM {source}"


_MATCHERS = {
    "match_net_contents": (
        ("net", r"SELECT *, 0 AS rank, '(?i)\b' || number || '(?:\.0+)?\s*m[l|i|!|1]\b|\b' || number || '(?:\.0+)?\s*millilit(?:er|re)s?\b' AS pattern FROM asked WHERE kind = 'NetContents'"),
        ("net_found", _lookup("net", "p.a <> '' AND contains(c.nl, p.a)", "p.number <> '' AND regexp_matches(c.nl, p.pattern)")),
        ("net_rows", _rows("net", "net_found", _HIT)),
    ),
    "match_alcohol": (
        ("alc", r"SELECT *, 0 AS rank, '(?i)\b' || number || '(?:\.0+)?\s*0?\s*(?:%|percent|per cent|alc\.?|alcohol|by vol(?:ume)?)|(?:alc\.?|alcohol)[.:]?\s*\b' || number || '(?:\.0+)?\b' AS pattern FROM asked WHERE kind = 'Alcohol'"),
        ("alc_found", _lookup("alc", "CASE WHEN p.number <> '' THEN regexp_matches(c.nl, p.pattern) ELSE p.a <> '' AND contains(c.nl, p.a) END")),
        ("alc_rows", _rows("alc", "alc_found", _HIT)),
    ),
    "match_product_type": (
        ("prod", "SELECT * FROM asked WHERE kind = 'ProductType'"),
        ("prod_probes", " UNION ALL ".join(f"SELECT app_id, pos, {i} AS rank, '{needle}' AS needle FROM prod WHERE contains({T.ascii_lower_sql('answer')}, '{word}')" for i, (word, needle, _) in enumerate(matchers.PRODUCTS))),
        ("prod_found", _lookup("prod_probes", "contains(c.nl, p.needle)")),
        ("prod_rows", _rows("prod", "prod_found", _HIT, matched_as="CASE f.way " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (*_, kind) in enumerate(matchers.PRODUCTS)) + " END")),
    ),
    "match_wording": (
        ("word", "SELECT * FROM asked WHERE kind = 'Wording'"),
        ("word_tokens", _words_of(4, "word")),
        ("word_found", f"SELECT *, {_NOWHERE} AS e FROM ({_coverage('word_tokens')})"),
        ("word_rows", _rows("word", "word_found", "CASE WHEN f.of_n IS NULL THEN 'EMPTY' WHEN f.found_n / f.of_n >= 0.9 THEN 'MATCH' WHEN f.found_n / f.of_n >= 0.5 THEN 'PARTIAL' ELSE 'NOT FOUND' END", found_n="f.found_n", of_n="f.of_n")),
    ),
    "match_name_address": (
        ("dba", f"SELECT *, {T.before_last_sql('answer', T.USED_ON_LABEL)} AS before FROM asked WHERE kind = 'NameAddress'"),
        ("dba_words", r"SELECT app_id, pos, list_filter(regexp_split_to_array(before, '\s+'), lambda x: x <> '') AS w FROM dba WHERE before IS NOT NULL"),
        ("dba_named", f"SELECT app_id, pos, 4 - n AS rank, {_NAME} AS dba_name FROM dba_words, (VALUES (4), (3), (2), (1)) v(n) WHERE len(w) >= n"),
        ("dba_probes", f"SELECT *, {T.norm_sql('dba_name')} AS needle FROM dba_named"),
        ("dba_hits", _lookup("dba_probes", "p.needle <> '' AND contains(c.nl, p.needle)", "p.needle <> '' AND contains(c.nlc, replace(p.needle, ' ', ''))")),
        ("dba_found", "SELECT h.app_id, h.pos, h.e, p.dba_name FROM dba_hits h JOIN dba_probes p ON h.app_id = p.app_id AND h.pos = p.pos AND p.rank = h.way // 2"),
        ("dba_rows", _rows("dba", "dba_found", f"CASE WHEN q.before IS NULL THEN 'SKIP' WHEN f.e IS NOT NULL THEN 'MATCH' ELSE 'NOT FOUND' END", f"CASE WHEN q.before IS NULL THEN {T.quoted(matchers.NO_TRADENAME)} ELSE '' END", "f.dba_name")),
    ),
    "match_admin": (
        ("adm", "SELECT * FROM asked WHERE kind = 'Admin'"),
        ("adm_found", f"SELECT app_id, pos, {_NOWHERE.replace('words', repr(''))} AS e FROM adm WHERE false"),
        ("adm_rows", _rows("adm", "adm_found", "'SKIP'", T.quoted(matchers.ADMINISTRATIVE))),
    ),
    "match_printed_text": (
        ("txt", "SELECT *, 0 AS rank FROM asked WHERE kind IN ('Brand', 'Fanciful', 'Appellation', 'Vintage')"),
        ("txt_whole", _lookup("txt", "p.a <> '' AND contains(c.nl, p.a)")),
        ("txt_rest", "SELECT *, list_filter(string_split(a, ' '), lambda t: length(t) >= 3) AS tokens FROM txt ANTI JOIN txt_whole USING (app_id, pos)"),
        ("txt_line", _lookup("txt_rest", "len(p.tokens) > 0 AND len(list_filter(p.tokens, lambda t: NOT contains(c.nl, t))) = 0")),
        ("txt_tokens", _words_of(3, "txt_rest ANTI JOIN txt_line USING (app_id, pos)")),
        ("txt_spread", f"SELECT app_id, pos, {_NOWHERE} AS e, found_n, of_n FROM ({_coverage('txt_tokens')}) WHERE found_n = of_n"),
        ("txt_found", "SELECT app_id, pos, e, NULL AS found_n, NULL AS of_n FROM txt_whole UNION ALL SELECT l.app_id, l.pos, l.e, len(r.tokens), len(r.tokens) FROM txt_line l JOIN txt_rest r USING (app_id, pos) UNION ALL SELECT app_id, pos, e, found_n, of_n FROM txt_spread"),
        ("txt_rows", _rows("txt", "txt_found", _HIT, found_n="f.found_n", of_n="f.of_n")),
    ),
}
_VERDICTS = {name: (*_FORM, *_CORPUS, _ASKED, *ctes) for name, ctes in _MATCHERS.items()}
_ALL_CTES = tuple(c for ctes in _MATCHERS.values() for c in ctes)
_ALL_ROWS = " UNION ALL ".join(f"SELECT * FROM {ctes[-1][0]}" for ctes in _MATCHERS.values())


def _mandatory(last: str) -> tuple[tuple[str, str], ...]:
    n = len(matchers.ANCHORS)
    whole = ("whole", "SELECT app_id, string_agg(nlc, '' ORDER BY ord) AS t FROM corpus GROUP BY 1")
    counted = ("counted", "SELECT p_partkey AS app_id, 0 AS pos, 0 AS rank, " + " + ".join(f"CASE WHEN contains(coalesce(t, ''), '{a}') THEN 1 ELSE 0 END" for a in matchers.ANCHORS) + " AS k FROM part LEFT JOIN whole ON p_partkey = app_id")
    anywhere = " OR ".join(f"contains(c.nlc, '{a}')" for a in matchers.ANCHORS)
    found = ("gw_found", _lookup("counted", "contains(c.nl, 'government') AND contains(c.nl, 'warning')", f"p.k > 0 AND ({anywhere})"))
    rows = f"""SELECT g.app_id, CAST(coalesce(l.last, -1) + 1 AS INT) AS pos, 'GW' AS num, '{matchers.MANDATORY_QUESTION}' AS question, '{matchers.MANDATORY_ANSWER}' AS answer,
      CASE WHEN k = {n} THEN 'MATCH' WHEN k > 0 THEN 'PARTIAL' ELSE 'NOT FOUND' END AS status, f.e IS NOT NULL AS found, coalesce(f.e.image, '') AS image, coalesce(f.e.line, '') AS line, coalesce(f.e.conf, -1.0) AS conf, CAST(k AS BIGINT) AS found_n, CAST({n} AS BIGINT) AS of_n,
      coalesce(f.e.x1, 0) AS line_x1, coalesce(f.e.y1, 0) AS line_y1, coalesce(f.e.x2, 0) AS line_x2, coalesce(f.e.y2, 0) AS line_y2, '{matchers.MANDATORY_NOTE}' AS note, true AS mandatory,
      CASE WHEN k = {n} THEN concat('SEEN - government warning complete (', k, '/{n} checks)') WHEN k > 0 THEN concat('INCOMPLETE - government warning (', k, '/{n} checks)') ELSE 'NOT SEEN - government warning is mandatory' END AS mandatory_message, CAST(NULL AS VARCHAR) AS matched_as
      FROM counted g LEFT JOIN gw_found f ON g.app_id = f.app_id LEFT JOIN ({last}) l ON g.app_id = l.app_id"""
    return whole, counted, found, ("gw_rows", rows)


_MATCHES = (*_FORM, *_CORPUS, _ASKED, *_ALL_CTES, *_mandatory("SELECT app_id, max(pos) AS last FROM asked GROUP BY 1"), ("verdicts", f"{_ALL_ROWS} UNION ALL SELECT * FROM gw_rows"))
_CLASS = (
    _PAGES, *_CORPUS,
    ("page2", "SELECT app_id, coalesce(max(CASE WHEN page = 2 THEN text END), '') AS t FROM pages GROUP BY 1"),
    ("named", f"SELECT app_id, regexp_matches(t, {T.quoted(matchers.CLASS_TYPE)}) AS asked, trim(regexp_extract(t, {T.quoted(matchers.CLASS_TYPE)}, 1), chr(32) || chr(9) || chr(13) || chr(10)) AS class_type FROM page2"),
    ("normed", f"SELECT *, {T.norm_sql('class_type')} AS n FROM named WHERE asked"),
    ("variants", "SELECT app_id, 0 AS pos, 0 AS rank, n AS variant FROM normed " + " ".join(f"UNION ALL SELECT app_id, 0, {i + 1}, '{v}' FROM normed WHERE n = 'table red wine'" for i, v in enumerate(matchers.TABLE_RED_WINE))),
    ("probes", f"SELECT *, {T.norm_sql('variant')} AS needle FROM variants"),
    ("hits", _lookup("probes", "p.needle <> '' AND contains(c.nl, p.needle)", "p.needle <> '' AND contains(c.nlc, replace(p.needle, ' ', ''))")),
    ("found", "SELECT h.app_id, h.e, p.variant FROM hits h JOIN probes p ON h.app_id = p.app_id AND p.rank = h.way // 2"),
)

# --- recognition --------------------------------------------------------------------------------------------------

_SCALED = (
    ("words", S.WORDS),
    ("scaled", "SELECT app_id, image, variant, seq, trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS text, conf, CAST(round(x1 / scale) AS INT) AS x, CAST(round(y1 / scale) AS INT) AS y, greatest(1, CAST(round((x2 - x1) / scale) AS INT)) AS w, greatest(1, CAST(round((y2 - y1) / scale) AS INT)) AS h FROM words WHERE trim(text, chr(32) || chr(9) || chr(13) || chr(10)) <> '' AND conf >= 0"),
)
_SHARED = "greatest(0, least(k.x + k.w, w.x + w.w) - greatest(k.x, w.x)) * greatest(0, least(k.y + k.h, w.y + w.h) - greatest(k.y, w.y)) / CAST(least(k.w * k.h, w.w * w.h) AS DOUBLE)"
#: Words from the top down, one of each image at a step: the open lines (first and last middle, tallest word), and the line that the word joins.
_NEAR = "list_position(list_transform(s.lines, lambda o: abs(r.mid - (o.first + o.last) / 2) < 0.6 * greatest(r.h, o.tall)), true)"
_JOINED = f"list_transform(s.lines, lambda o, i: CASE WHEN i = {_NEAR} THEN {{'first': o.first, 'last': r.mid, 'tall': greatest(o.tall, r.h)}} ELSE o END)"
_OPENED = "{'first': r.mid, 'last': r.mid, 'tall': r.h}"
_SWEEP = f"""
SELECT r.app_id, r.k, CAST(1 AS BIGINT) AS line, [{_OPENED}] AS lines FROM ranked r WHERE r.k = 1
UNION ALL SELECT r.app_id, r.k, CASE WHEN coalesce({_NEAR}, 0) > 0 THEN {_NEAR} ELSE len(s.lines) + 1 END, CASE WHEN coalesce({_NEAR}, 0) > 0 THEN {_JOINED} ELSE list_append(s.lines, {_OPENED}) END
FROM swept s JOIN ranked r ON r.app_id = s.app_id AND r.k = s.k + 1
"""
_PLAIN_NAME = "(filename IS NULL OR filename IN ('', '.', '..') OR contains(filename, '/') OR contains(filename, chr(92)))"

_PARTS = (*_MATCHES, *_BOXES, *(c for c in _CLASS if c[0] not in {"pages", "lines", "corpus"}))
_CLASSED = ("classed", "SELECT n.app_id, CASE WHEN NOT asked THEN 'SKIP' WHEN f.e IS NOT NULL THEN 'MATCH' ELSE 'NOT FOUND' END AS status, CASE WHEN asked THEN class_type ELSE '' END AS class_type, coalesce(f.variant, '') AS matched_as, coalesce(f.e.image, '') AS image, coalesce(f.e.line, '') AS line FROM named n LEFT JOIN found f USING (app_id)")
_TEXTS = ("texts", f"SELECT app_id, coalesce(nullif(regexp_extract(text, {T.quoted(T.TTB_ID)}, 1), ''), nullif(regexp_extract(text, {T.quoted(T.BARE_TTB_ID)}, 1), ''), '') AS ttb_id FROM pages WHERE page = 1")
_OBJECT = lambda prefix: "{" + ", ".join(f"'{c}': CAST({prefix}{c} AS DOUBLE)" for c in form.BOX) + "}"
_ENTRY = "'num': num, 'question': question, 'answer': answer"
_EVIDENCE = "{'found': found, 'image': image, 'line': line, 'conf': conf, 'found_n': coalesce(found_n, 0), 'of_n': coalesce(of_n, 0), 'line_x1': line_x1, 'line_y1': line_y1, 'line_x2': line_x2, 'line_y2': line_y2}"
_VERDICT = f"{_ENTRY}, 'status': status, 'mandatory': mandatory, 'mandatory_message': mandatory_message, 'evidence': {_EVIDENCE}, 'note': note"
_DOCUMENTS = _with(
    *_PARTS, _CLASSED, _TEXTS, ("apps", S.APPS), ("images", S.IMAGES), ("rendered", S.RENDERED),
    ("d_pages", "SELECT app_id, to_json(list({'page': page, 'chars': octet_length(encode(text))} ORDER BY page)) AS pages, to_json(list(text ORDER BY page)) AS raw_text FROM pages GROUP BY 1"),
    ("d_form", f"SELECT app_id, to_json(list(CASE WHEN bbox_x1 IS NULL THEN to_json({{{_ENTRY}}}) ELSE to_json({{{_ENTRY}, 'bbox': {_OBJECT('bbox_')}}}) END ORDER BY pos)) AS form_qa FROM boxed_form GROUP BY 1"),
    ("d_rendered", "SELECT app_id, to_json(list({'page': page, 'name': name, 'width': width, 'height': height, 'path': path})) AS document_pages FROM rendered GROUP BY 1"),
    ("d_images", "SELECT app_id, to_json(list({'page': page, 'name': name, 'width': width, 'height': height, 'path': path, 'bbox': bbox} ORDER BY img_pos)) AS images FROM images GROUP BY 1"),
    ("read", "SELECT app_id, image, list({'text': text, 'conf': conf} ORDER BY line_pos) AS l, string_agg(text, ' ' ORDER BY line_pos) AS t FROM corpus GROUP BY 1, 2"),
    ("d_ocr", "SELECT i.app_id, to_json(map_from_entries(list({'k': name, 'v': {'width': width, 'height': height, 'lines': coalesce(l, []), 'text': coalesce(t, '')}} ORDER BY i.img_pos))) AS ocr FROM images i LEFT JOIN read r ON i.app_id = r.app_id AND i.name = r.image GROUP BY 1"),
    ("d_matches", f"SELECT v.app_id, to_json(list(CASE WHEN mandatory OR bbox_x1 IS NULL THEN to_json({{{_VERDICT}}}) ELSE to_json({{{_VERDICT}, 'form_bbox': {_OBJECT('bbox_')}}}) END ORDER BY v.pos)) AS matches FROM verdicts v LEFT JOIN (SELECT app_id, pos, bbox_x1, bbox_y1, bbox_x2, bbox_y2 FROM boxed_form) b USING (app_id, pos) GROUP BY 1"),
) + """SELECT a.app_id, CAST(to_json({'pdf': pdf, 'task': 'both', 'ttb_id': coalesce(ttb_id, ''), 'pages': coalesce(pages, '[]'::JSON), 'raw_text': coalesce(raw_text, '[]'::JSON), 'form_qa': coalesce(form_qa, '[]'::JSON), 'document_pages': coalesce(document_pages, '[]'::JSON),
  'images': coalesce(images, '[]'::JSON), 'ocr': coalesce(ocr, '{}'::JSON), 'matches': coalesce(matches, '[]'::JSON), 'class_type': {'status': c.status, 'class_type': c.class_type, 'matched_as': c.matched_as}}) AS VARCHAR) AS json
  FROM apps a LEFT JOIN texts USING (app_id) LEFT JOIN d_pages USING (app_id) LEFT JOIN d_form USING (app_id) LEFT JOIN d_rendered USING (app_id) LEFT JOIN d_images USING (app_id) LEFT JOIN d_ocr USING (app_id) LEFT JOIN d_matches USING (app_id) LEFT JOIN classed c USING (app_id)"""
_REPORT_LINE = """concat_ws(chr(10),
      concat('  ', CASE status WHEN 'MATCH' THEN '[OK]  ' WHEN 'PARTIAL' THEN '[~]   ' WHEN 'NOT FOUND' THEN '[MISS]' WHEN 'SKIP' THEN '[n/a] ' ELSE '[?]   ' END, ' ', num, '. ', question),
      concat('        answer : ', answer),
      CASE WHEN found AND line <> '' THEN concat('        label  : "', line, '" on ', image, CASE WHEN conf >= 0 THEN concat(', conf ', conf) ELSE '' END,
             CASE WHEN of_n IS NOT NULL THEN concat(' (', found_n, '/', of_n, ' tokens)') ELSE '' END, CASE WHEN coalesce(matched_as, '') <> '' THEN concat(' (matched as ''', matched_as, ''')') ELSE '' END)
           WHEN status = 'SKIP' THEN concat('        note   : ', note) ELSE '        label  : (not found)' END)"""
_REPORTS = _with(
    *_PARTS, _CLASSED, _TEXTS, ("apps", S.APPS), ("images", S.IMAGES),
    ("r_pages", "SELECT app_id, concat(' Pages : [', string_agg(page, ', ' ORDER BY page), '] (chars: ', string_agg(octet_length(encode(text)), ', ' ORDER BY page), ')') AS summary FROM pages GROUP BY 1"),
    ("r_form", "SELECT app_id, count(*) AS n, string_agg(concat('    ', num, '. ', question, chr(10), '          -> ', CASE WHEN answer = '' THEN '(blank)' ELSE answer END), chr(10) ORDER BY pos) AS t FROM form GROUP BY 1"),
    ("r_images", "SELECT app_id, count(*) AS n, string_agg(concat('    p', page, ' ', name, ': ', path, ' (', width, 'x', height, ', png)'), chr(10) ORDER BY img_pos) AS t FROM images GROUP BY 1"),
    ("r_read", "SELECT app_id, string_agg(t, chr(10) ORDER BY img_pos, line_pos) AS t FROM (SELECT app_id, img_pos, -1 AS line_pos, concat('    --- ', name, ' ---') AS t FROM images UNION ALL SELECT c.app_id, c.img_pos, line_pos, concat('      ', text, '   (conf ', CAST(round(conf) AS BIGINT), ')') FROM corpus c SEMI JOIN images i ON c.app_id = i.app_id AND c.image = i.name) GROUP BY 1"),
    ("r_verdicts", f"SELECT app_id, count(*) AS n, string_agg({_REPORT_LINE}, chr(10) ORDER BY pos) AS t FROM verdicts GROUP BY 1"),
) + """SELECT a.app_id, concat_ws(chr(10), repeat('=', 78), concat(' PDF ANALYSIS — ', pdf), repeat('=', 78), concat(' TTB ID: ', coalesce(nullif(ttb_id, ''), '(none found)')), coalesce(summary, ' Pages : [] (chars: )'), '',
    concat('[1] FORM Q&A — parsed from page 1 (', coalesce(f.n, 0), ' fields)'), f.t, '', concat('[2] EMBEDDED GRAPHICS — ', coalesce(i.n, 0), ' image(s)'), i.t, '', '[3] OCR — backend: table', r.t, '',
    concat('[4] MATCH — label text vs form answers (', coalesce(v.n, 0), ' fields)'), v.t,
    CASE WHEN c.status <> 'SKIP' THEN concat_ws(chr(10), concat('  ', CASE WHEN c.status = 'MATCH' THEN '[OK]  ' ELSE '[MISS]' END, ' page-2 class/type: ', c.class_type),
      CASE WHEN c.status = 'MATCH' AND c.line <> '' THEN concat('        label  : "', c.line, '" on ', c.image, CASE WHEN c.matched_as <> '' THEN concat(' (matched as ''', c.matched_as, ''')') ELSE '' END) WHEN c.status = 'NOT FOUND' THEN '        label  : (not found)' END) END,
    repeat('=', 78)) AS report
  FROM apps a LEFT JOIN texts USING (app_id) LEFT JOIN r_pages USING (app_id) LEFT JOIN r_form f USING (app_id) LEFT JOIN r_images i USING (app_id) LEFT JOIN r_read r USING (app_id) LEFT JOIN r_verdicts v USING (app_id) LEFT JOIN classed c USING (app_id)"""

#: The drawn images differ by p_size % 20 alone, so each kind is worked out once, pixel by pixel.
_VARIANTS = _with(
    ("kinds", "SELECT DISTINCT CAST(p_size % 20 AS INT) AS k FROM part"),
    ("raw", "SELECT k, x, y, CASE WHEN x < k THEN 64 ELSE 208 END AS v FROM kinds, range(32) a(x), range(24) b(y)"),
    ("along", "SELECT p.k, p.x, p.y, sum(q.v) // 19 AS v FROM raw p CROSS JOIN range(-9, 10) d(i) JOIN raw q ON q.k = p.k AND q.y = p.y AND q.x = least(31, greatest(0, p.x + i)) GROUP BY 1, 2, 3"),
    ("behind", "SELECT p.k, p.x, p.y, sum(q.v) // 19 AS v FROM along p CROSS JOIN range(-9, 10) d(i) JOIN along q ON q.k = p.k AND q.x = p.x AND q.y = least(23, greatest(0, p.y + i)) GROUP BY 1, 2, 3"),
    ("flat", "SELECT r.k, r.x, r.y, CAST(trunc(least(255.0, CAST(r.v AS DOUBLE) / (CAST(b.v AS DOUBLE) + 1e-6) * 255.0)) AS INT) AS v FROM raw r JOIN behind b USING (k, x, y)"),
    ("near", "SELECT p.k, p.x, p.y, p.v, CAST(sum(q.v) AS DOUBLE) AS s1, CAST(sum(q.v * q.v) AS DOUBLE) AS s2, (p.x + 12 - greatest(0, p.x - 11)) * (p.y + 12 - greatest(0, p.y - 11)) AS n FROM flat p JOIN flat q ON q.k = p.k AND q.x BETWEEN p.x - 11 AND p.x + 11 AND q.y BETWEEN p.y - 11 AND p.y + 11 GROUP BY 1, 2, 3, 4"),
    ("cut", "SELECT k, x, y, CASE WHEN v > s1 / n * (1 + 0.2 * (sqrt(greatest(0, s2 / n - s1 / n * (s1 / n))) / CAST(128 AS DOUBLE) - 1)) THEN 255 ELSE 0 END AS v FROM near"),
    ("dark", "SELECT k, count(*) FILTER (v = 0) > 384 AS inverted FROM cut GROUP BY 1"),
    ("sums", "SELECT k, 'raw' AS variant, sum(v) AS s FROM raw GROUP BY 1 UNION ALL SELECT k, 'flat', sum(v) FROM flat GROUP BY 1 UNION ALL SELECT k, 'bin', sum(CASE WHEN inverted THEN 255 - v ELSE v END) FROM cut JOIN dark USING (k) GROUP BY 1"),
) + "SELECT p_partkey AS app_id, variant, 32 AS w, 24 AS h, CAST(s AS BIGINT) AS brightness FROM part JOIN sums ON k = p_size % 20"

SQL = {
    "first_evidence": _FIRST + "SELECT p.app_id, p.pos, p.a, CASE WHEN h.e IS NULL THEN 'NOT FOUND' ELSE 'MATCH' END AS status, coalesce(h.e.image, '') AS image, coalesce(h.e.line, '') AS line FROM probes p LEFT JOIN hits h USING (app_id, pos)",
    "indexed_evidence": _FIRST + "SELECT app_id, pos, e.image AS image, e.line AS line FROM hits",
    "norm_lines": _with(_SPLIT, _DOC_LINES, _DOC_CORPUS) + "SELECT app_id, img_pos, line_pos, nl, nlc FROM corpus",
    "document_checklist": _with(
        _SPLIT, _DOC_LINES, _DOC_CORPUS,
        ("whole", "SELECT app_id, string_agg(nlc, '' ORDER BY ord) AS t FROM corpus GROUP BY 1"),
        ("counted", "SELECT doc_id AS app_id, " + " + ".join(f"CASE WHEN contains(coalesce(t, ''), '{a}') THEN 1 ELSE 0 END" for a in LICENCE_ANCHORS) + " AS k FROM documents LEFT JOIN whole ON doc_id = app_id"),
        ("hits", f"SELECT g.app_id, arg_min(c.text, CASE WHEN contains(nl, 'government') AND contains(nl, 'warning') THEN 0 ELSE 1 END * {_STEP} + ord) AS line FROM counted g JOIN corpus c ON g.app_id = c.app_id AND ((contains(nl, 'government') AND contains(nl, 'warning')) OR (k > 0 AND ({' OR '.join(f"contains(nlc, '{a}')" for a in LICENCE_ANCHORS)}))) GROUP BY 1"),
    ) + "SELECT g.app_id, CAST(k AS BIGINT) AS found_n, h.line IS NOT NULL AS found, coalesce(h.line, '') AS line FROM counted g LEFT JOIN hits h USING (app_id)",
    "text_functions": f"SELECT doc_id, md5({T.ascii_lower_sql('text')}) AS lower_md5, length(trim(concat(' ', chr(9), text, ' ', chr(10)), chr(32) || chr(9) || chr(13) || chr(10))) AS trimmed, length(text) + 1 AS before, NOT contains({T.ascii_lower_sql('text')}, 'the') AS absent, regexp_extract(text, {T.quoted(T.NUMBER)}, 1) AS number FROM documents",
    "field_kinds": _with(*_FORM) + f"SELECT app_id, pos, {_KIND} AS kind FROM form",
    "ttb_ids": _with(_PAGES) + f"SELECT app_id, coalesce(nullif(regexp_extract(text, {T.quoted(T.TTB_ID)}, 1), ''), nullif(regexp_extract(text, {T.quoted(T.BARE_TTB_ID)}, 1), ''), '') AS ttb_id FROM pages WHERE page = 1",
    "form_entries": _with(*_FORM) + "SELECT * FROM form",
    "form_with_product": _with(*_FORM, *_PRODUCTS, ("placed", "SELECT *, contains(lower(question), 'type of product') AS asks, row_number() OVER (PARTITION BY app_id, contains(lower(question), 'type of product') ORDER BY pos) AS k FROM form")) + "SELECT f.app_id, f.pos, f.num, f.question, CASE WHEN asks AND k = 1 AND coalesce(product, '') <> '' THEN product ELSE answer END AS answer FROM placed f LEFT JOIN products USING (app_id)",
    "form_boxes": _with(*_FORM, *_BOXES) + "SELECT * FROM boxed_form",
    "form_widgets": _with(*_FORM, *_BOXES, *_WIDGETS) + f"SELECT * EXCLUDE (seq, applied) REPLACE (CAST(row_number() OVER (PARTITION BY app_id ORDER BY pos NULLS LAST, seq) - 1 AS INT) AS pos) FROM over WHERE NOT applied OR {_KIND} <> 'Admin'",
    "checkbox_ratios": _with(_PRODUCTS[0]) + "SELECT * FROM ratios",
    "product_checkboxes": _with(*_PRODUCTS) + "SELECT * FROM products",
    **{name: _with(*ctes) + f"SELECT * FROM {ctes[-1][0]}" for name, ctes in _VERDICTS.items()},
    "mandatory_check": _with(*_CORPUS, *_mandatory("SELECT p_partkey AS app_id, 9 AS last FROM part")) + "SELECT * FROM gw_rows",
    "matches": _with(*_MATCHES, *_BOXES) + "SELECT v.*, " + ", ".join(f"CASE WHEN NOT mandatory THEN b.bbox_{c} END AS form_{c}" for c in form.BOX) + " FROM verdicts v LEFT JOIN boxed_form b USING (app_id, pos)",
    "class_types": _with(*_CLASS) + "SELECT n.app_id, CASE WHEN NOT asked THEN 'SKIP' WHEN f.e IS NOT NULL THEN 'MATCH' ELSE 'NOT FOUND' END AS status, CASE WHEN asked THEN class_type ELSE '' END AS class_type, coalesce(f.variant, '') AS matched_as, coalesce(f.e.image, '') AS image, coalesce(f.e.line, '') AS line FROM named n LEFT JOIN found f USING (app_id)",
    "tally": _with(*_MATCHES) + "SELECT app_id, count(*) FILTER (status = 'MATCH') AS n_match, count(*) FILTER (status <> 'SKIP') AS n_checked FROM verdicts GROUP BY 1",
    "scaled_words": _with(*_SCALED) + "SELECT app_id, seq, variant, text, conf, x, y, w, h FROM scaled",
    "best_variants": _with(*_SCALED, ("scored", "SELECT app_id, variant, avg(conf) * least(1.0, count(*) / 20) AS score FROM scaled GROUP BY 1, 2")) + "SELECT app_id, variant, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY score DESC, list_position(['raw', 'flat', 'bin'], variant)) AS place FROM scored) WHERE place = 1",
    "merged_words": _with(
        *_SCALED,
        ("listed", "SELECT app_id, list([{'text': text, 'conf': conf, 'x': x, 'y': y, 'w': w, 'h': h, 'seq': seq}] ORDER BY conf DESC, w * h DESC, seq) AS ws FROM scaled GROUP BY 1"),
        ("kept", f"SELECT app_id, list_reduce(ws, lambda acc, one: CASE WHEN len(list_filter(acc, lambda k: {_SHARED.replace('w.x', 'one[1].x').replace('w.y', 'one[1].y').replace('w.w', 'one[1].w').replace('w.h', 'one[1].h')} >= CASE WHEN lower(k.text) = lower(one[1].text) THEN 0.2000000001 ELSE 0.5 END)) > 0 THEN acc ELSE list_concat(acc, one) END) AS ks FROM listed"),
        ("placed", "SELECT app_id, unnest(ks) AS k, generate_subscripts(ks, 1) - 1 AS place FROM kept"),
    ) + "SELECT app_id, CAST(place AS INT) AS place, k.seq AS seq, k.text AS text, k.conf AS conf, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM placed",
    "grouped_lines": _with(
        *_SCALED,
        ("ranked", "SELECT *, y + CAST(h AS DOUBLE) / 2 AS mid, row_number() OVER (PARTITION BY app_id ORDER BY y, seq) AS k FROM scaled"),
        ("swept", _SWEEP),
        ("joined", "SELECT s.line, r.* FROM swept s JOIN ranked r USING (app_id, k)"),
        ("lines", "SELECT app_id, line, string_agg(text, ' ' ORDER BY x, seq) AS text, round(avg(conf), 6) AS conf, arg_min(y, x * 1000000 + seq) AS y, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM joined GROUP BY 1, 2"),
    ).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY y, line) - 1 AS INT) AS line_pos, text, conf, y, x1, y1, x2, y2 FROM lines",
    "image_variants": _VARIANTS,
    "enlarged_images": """WITH placed AS (SELECT k, x * (CAST(32 AS DOUBLE) / 48) AS sx FROM range(20) a(k), range(48) b(x)),
      near AS (SELECT k, sx - floor(sx) AS f, CASE WHEN floor(sx) < k THEN 64 ELSE 208 END AS v0, CASE WHEN least(31, floor(sx) + 1) < k THEN 64 ELSE 208 END AS v1 FROM placed),
      sums AS (SELECT k, 36 * sum(floor((1 - f) * v0 + f * v1 + 0.5)) AS s FROM near GROUP BY 1)
      SELECT p_partkey AS app_id, 48 AS w, 36 AS h, CAST(s AS BIGINT) AS brightness FROM part JOIN sums ON k = p_size % 20""",
    "rendered_pages": _with(_PAGES) + "SELECT app_id, page, 'document_p1.png' AS name FROM pages WHERE page = 1",
    "samples": _with(("runs", S.RUNS)) + "SELECT filename AS name, round(size_bytes / CAST(1024 AS DOUBLE), 1) AS size_kb, true AS synthetic FROM runs WHERE filename = 'label.pdf'",
    "image_texts": _with(_SPLIT, _DOC_LINES) + "SELECT app_id, image, string_agg(text, ' ' ORDER BY line_pos) AS text FROM lines GROUP BY 1, 2",
    "recognition_passes": _with(("sized", SIZED), ("ways", "SELECT *, least(scale, cap / greatest(width, height)) AS factor FROM sized, (VALUES (CAST(2 AS DOUBLE), CAST(1400 AS DOUBLE)), (4, 2800)) v(scale, cap), (VALUES (3), (11)) m(psm)")) + "SELECT app_id, name, psm, scale, round(factor, 6) AS factor, CAST(round(width * factor) AS INT) AS width, CAST(round(height * factor) AS INT) AS height FROM ways WHERE factor > 1",
    "page_images": _with(("blocks", S.BLOCKS)) + "SELECT app_id, page, CAST(row_number() OVER (PARTITION BY app_id ORDER BY page, block_seq) - 1 AS INT) AS img_pos, concat('p', page, '_', row_number() OVER (PARTITION BY app_id, page ORDER BY block_seq), '.png') AS name, w AS width, h AS height, concat_ws(' ', x0, y0, x1, y1) AS bbox FROM blocks WHERE w >= 50 AND h >= 50 AND page <= 3",
    "polygon_lines": _with(("words", S.WORDS), ("kept", "SELECT * FROM (SELECT * REPLACE (trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS text) FROM words) WHERE text <> ''")) + "SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY seq) - 1 AS INT) AS line_pos, text, conf, CAST(trunc(x1 + 0.7) AS INT) AS x1, CAST(trunc(y1 - 0.4) AS INT) AS y1, CAST(trunc(x2 + 0.7) AS INT) AS x2, CAST(trunc(y2 - 0.4) AS INT) AS y2 FROM kept",
    "page_chars": _with(("chars", CHARS), ("spaced", "SELECT *, CASE WHEN x0 - lag(x1) OVER w > 0.15 * (y1 - y0) AND lag(c) OVER w <> ' ' THEN ' ' || c ELSE c END AS piece FROM chars WINDOW w AS (PARTITION BY app_id, page, line ORDER BY seq)")) + "SELECT app_id, line, string_agg(piece, '' ORDER BY seq) AS text FROM spaced GROUP BY app_id, page, line",
    "page_list": _with(_PAGES) + "SELECT app_id, page, octet_length(encode(text)) AS chars FROM pages",
    "label_image_order": _with(("lines", S.LABEL_LINES)) + "SELECT app_id, CAST(dense_rank() OVER (PARTITION BY app_id ORDER BY image) - 1 AS INT) AS img_pos, image, line_pos, text FROM lines",
    "image_names": _with(("images", NAMED_IMAGES)) + "SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY name) - 1 AS INT) AS img_pos, CAST(regexp_extract(name, '^p(\\d+)_', 1) AS INT) AS page, CAST(regexp_extract(name, '_(\\d+)\\.png$', 1) AS INT) AS n, name FROM images WHERE regexp_matches(name, '^p(\\d+)_(\\d+)\\.png$')",
    "uploads": _with(("runs", S.RUNS)) + f"SELECT run_id, filename, CASE WHEN {_PLAIN_NAME} THEN 'invalid file name' WHEN NOT ends_with(lower(filename), '.pdf') THEN 'only PDF files are accepted' END AS error, CASE WHEN {_PLAIN_NAME} OR NOT ends_with(lower(filename), '.pdf') THEN 400 WHEN size_bytes > 50000000 THEN 413 WHEN NOT contains(substr(head, 1, 1024), '%PDF-') THEN 400 ELSE 200 END AS status FROM runs",
    "expired_runs": _with(("runs", S.RUNS)) + "SELECT run_id, filename FROM runs WHERE regexp_matches(run_id, '^(?:run|sample)_[0-9a-f]{32}$') AND mtime < TIMESTAMP '2024-01-31 00:00:00'",
    "image_urls": _with(("runs", S.RUNS), ("stored", S.STORED)) + "SELECT run_id, image AS name, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.path = concat('file:/srv/runs/', runs.run_id, '/images/', runs.image)) AND regexp_matches(run_id, '^(?:run|sample)_[0-9a-f]{32}$') AND regexp_matches(lower(image), '^[a-z0-9_.-]+\\.(?:png|jpe?g)$') THEN concat('/runs/', run_id, '/images/', image) END AS url FROM runs",
    "report_lines": _with(*_MATCHES) + f"SELECT app_id, pos, {_REPORT_LINE} AS text FROM verdicts",
    "json_documents": _DOCUMENTS,
    "reports": _REPORTS,
    "form_documents": _with(*_FORM, *_BOXES) + "SELECT * FROM boxed_form",
}
