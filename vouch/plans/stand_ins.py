"""Applications made from the driver's tables, in SQL that Spark and DuckDB both run.

The driver has no forms or labels. Every row of `part` becomes an application with a form (page 1), a certificate
(page 2) and a label of two images; `documents` become labels of free text. Tables are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NL = "chr(10)"
#: A label's brand and number words, by part.
_BRAND = "upper(concat(replace(p_brand, '#', ' '), ' ', p_name))"
_OTHER = "concat('Château ', upper(p_type))"


def _lines(*parts: str) -> str:
    return "concat(" + f", {_NL}, ".join(parts) + ")"


PAGE_1 = _lines(
    "'OMB No. 1513-0020 (12/31/2027)'",
    "'FOR TTB USE ONLY'",
    "'TTB ID'",
    "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(26000000000000 + p_partkey AS STRING) END",
    "'  1. REP. ID. NO. (If any)'",
    "'(If any)'",
    "'2. PLANT REGISTRY/BASIC PERMIT NO. (Required)'",
    "concat('BWN-VA-', CAST(p_partkey AS STRING))",
    "'5. TYPE OF PRODUCT (Required)'",
    "CASE p_partkey % 3 WHEN 0 THEN 'WINE' WHEN 1 THEN 'DISTILLED SPIRITS' ELSE 'MALT BEVERAGE' END",
    "'6. BRAND NAME (Required)'",
    f"CASE WHEN p_partkey % 5 = 0 THEN {_OTHER} ELSE {_BRAND} END",
    "'7. FANCIFUL NAME (If any)'",
    "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat(p_type, ' ', p_name) END",
    "'8. NAME AND ADDRESS OF APPLICANT AS SHOWN ON PLANT REGISTRY, BASIC'",
    "'PERMIT OR NOTICE. INCLUDE APPROVED DBA OR TRADENAME'",
    "CASE WHEN p_partkey % 11 = 0 THEN 'IF USED ON LABEL' ELSE 'IF USED ON LABEL (Required)' END",
    "concat(upper(p_type), ' CELLARS, LLC')",
    "concat('12 MAIN ST NAPA CA 94558 ', upper(p_type), ' CELLARS.', CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ' (Used on label)' END)",
    "'10. NET CONTENTS'",
    "concat(CAST(p_size * 15 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN ' MILLILITERS' ELSE ' ml' END)",
    "'11. ALCOHOL CONTENT'",
    "concat(CAST(p_size % 20 + 5 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END)",
    "'13. WINE APPELLATION (If on label)'",
    "CASE WHEN p_partkey % 3 = 0 THEN 'Côte de Nuits' ELSE '---' END",
    "'PART II - APPLICANT CERTIFICATION'",
    "'Under the penalties of perjury, I declare'",
    "'15. SHOW ANY INFORMATION THAT IS BLOWN, BRANDED OR EMBOSSED (e.g., net contents)'",
    "concat('refreshing ', p_name, ' aged in oak casks ', CASE WHEN p_partkey % 4 = 1 THEN 'bottled by cellars' ELSE 'of no further sort' END)",
    "'1/2'",
)
PAGE_2 = _lines("'CERTIFICATE'", "'CLASS/TYPE DESCRIPTION'", "CASE p_partkey % 4 WHEN 0 THEN 'TABLE RED WINE' WHEN 1 THEN ' Straight Whisky ' WHEN 2 THEN 'Rosé Wine' ELSE 'MALT BEVERAGE' END", "'END'")

PAGES = f"""
SELECT p_partkey AS app_id, 1 AS page, {PAGE_1} AS text FROM {{part}}
UNION ALL SELECT p_partkey AS app_id, 2 AS page, {PAGE_2} AS text FROM {{part}} WHERE p_partkey % 9 <> 8
"""

_WARNING = (
    "GOVERNMENT WARNING: (1) ACCORDING TO THE", "SURGEON GENERAL, WOMEN SHOULD NOT", "DRINK ALCOHOLIC BEVERAGES DURING PREGNANCY", "BECAUSE OF THE RISK OF BIRTH DEFECTS.",
    "(2) CONSUMPTION OF ALCOHOLIC BEVERAGES IMPAIRS YOUR", "ABILITY TO DRIVE A CAR OR OPERATE MACHINERY,", "AND MAY CAUSE HEALTH PROBLEMS.",
)
_LABEL = [
    (0, f"CASE WHEN p_partkey % 3 = 1 THEN concat(replace(p_brand, '#', ' '), '  ', p_name, ' — est. 1889') WHEN p_partkey % 3 = 2 THEN p_name ELSE lower({_BRAND}) END"),
    (0, "concat(CAST(p_size * 15 AS STRING), CASE p_partkey % 4 WHEN 0 THEN ' ml' WHEN 1 THEN 'ML.' WHEN 2 THEN ' mi' ELSE ' oz' END)"),
    (0, "CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size % 20 + 5 AS STRING), '.5% ALC/VOL') WHEN 1 THEN concat('Alc. ', CAST(p_size % 20 + 5 AS STRING), ' BY VOL') WHEN 2 THEN concat(CAST(p_size % 20 + 5 AS STRING), '.5%') ELSE concat(CAST(p_size % 20 + 5 AS STRING), ' by volume') END"),
    (1, "CASE p_partkey % 5 WHEN 0 THEN 'REDWINE-CONTAINSSULFITES' WHEN 1 THEN 'Distilled  Spirits' WHEN 2 THEN 'Premium malt beverage' WHEN 3 THEN 'Vino rosso da tavola' ELSE 'Straight whisky' END"),
    (1, "CASE WHEN p_partkey % 2 = 0 THEN concat('BOTTLED BY ', p_type, ' CELLARS, NAPA') ELSE concat('BOTTLEDBY', p_type, 'CELLARS') END"),
    (1, "CASE WHEN p_partkey % 6 = 3 THEN 'APPELLATION COTE DE NUITS' ELSE 'Aged in oak casks' END"),
]


def _label_rows() -> str:
    rows, n = [], {0: 0, 1: 0}
    box = lambda pos: f"CAST(50 + (p_partkey + {pos}) % 50 AS DOUBLE) / 100 AS conf, CAST(p_partkey % 40 AS INT) AS x1, {20 * pos} AS y1, CAST(p_partkey % 40 + 200 AS INT) AS x2, {20 * pos + 15} AS y2"
    for image, text in _LABEL:
        rows.append(f"SELECT p_partkey AS app_id, {image} AS img_pos, 'p2_{image + 1}.png' AS image, {n[image]} AS line_pos, {text} AS text, {box(n[image])} FROM {{part}} WHERE p_partkey % 13 <> 12")
        n[image] += 1
    for i, text in enumerate(_WARNING):
        shown = "p_partkey % 3 = 0" if i > 2 else "p_partkey % 3 <> 2"
        rows.append(f"SELECT p_partkey AS app_id, 1 AS img_pos, 'p2_2.png' AS image, {n[1] + i} AS line_pos, '{text}' AS text, {box(n[1] + i)} FROM {{part}} WHERE p_partkey % 13 <> 12 AND {shown}")
    return " UNION ALL ".join(rows)


LABEL_LINES = _label_rows()

DOCUMENT_PAGES = "SELECT doc_id AS app_id, text FROM {documents}"

_BOUNDS = "CAST(p_partkey % 90 AS DOUBLE) + {0} AS x1, 20.5 + {0} AS y1, CAST(p_partkey % 90 AS DOUBLE) + 60.25 AS x2, CAST(30 + {0} AS DOUBLE) AS y2"


def _widget(seq: int, name: str, value: str, where: str = "true") -> str:
    return f"SELECT p_partkey AS app_id, {seq} AS seq, '{name}' AS name, {value} AS value, {_BOUNDS.format(seq)} FROM {{part}} WHERE {where}"


WIDGETS = " UNION ALL ".join((
    _widget(0, "Check Box22", "CASE p_partkey % 4 WHEN 0 THEN 'Wine' WHEN 1 THEN '/Off' WHEN 2 THEN 'Spirits ' ELSE 'other' END", "p_partkey % 2 = 0"),
    _widget(1, "6. BRAND NAME", "concat(' ', p_name, ' ')", "p_partkey % 3 = 0"),
    _widget(2, "6. BRAND NAME again", "upper(p_name)", "p_partkey % 6 = 0"),
    _widget(3, "14. GRAPE VINTAGE", "CAST(1990 + p_size AS STRING)", "p_partkey % 4 = 0"),
    _widget(4, "applicant phone", "'555'", "p_partkey % 5 = 0"),
    _widget(5, "", "'no name'"),
    _widget(6, "Check Box22", "'malt'", "p_partkey % 12 = 0"),
    _widget(7, "14. GRAPE VINTAGE (again)", "'2001'", "p_partkey % 8 = 0"),
))

WORDS = """
SELECT l_orderkey AS app_id, 'p2_1.png' AS image, CASE CAST(l_linenumber AS INT) % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'flat' ELSE 'bin' END AS variant,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS seq, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE concat(CASE WHEN l_partkey % 2 = 0 THEN 'Wine' ELSE 'WINE' END, CAST(l_partkey % 4 AS STRING)) END AS text,
       CAST(l_quantity AS DOUBLE) - CASE WHEN l_partkey % 17 = 0 THEN 100 ELSE 0 END AS conf,
       CAST((l_partkey * 37) % 300 AS INT) AS x1, CAST((l_linenumber * 23 + l_suppkey % 11) % 90 AS INT) AS y1,
       CAST((l_partkey * 37) % 300 + 20 + l_suppkey % 60 AS INT) AS x2, CAST((l_linenumber * 23 + l_suppkey % 11) % 90 + 12 + l_partkey % 13 AS INT) AS y2, CAST(2 AS DOUBLE) AS scale
FROM {lineitem}
"""

BLOCKS = """
SELECT l_orderkey AS app_id, CAST(l_linenumber % 5 + 1 AS INT) AS page, CAST(l_partkey * 100 + l_suppkey AS INT) AS block_seq,
       CAST(l_quantity * 3 AS INT) AS w, CAST(40 + l_partkey % 200 AS INT) AS h, CAST(l_linenumber AS INT) AS x0, CAST(l_suppkey AS INT) AS y0, CAST(l_linenumber + l_quantity AS INT) AS x1, CAST(l_suppkey + 50 AS INT) AS y1
FROM {lineitem}
"""

#: DuckDB's cast rounds to the nearest whole number, halves to even; Spark's cuts, so frame() rounds first.
_SIZE, _SIZE_IN_SPARK = "CAST(value * 1000000 AS BIGINT)", "CAST(rint(value * 1000000) AS BIGINT)"
RUNS = """
SELECT CASE WHEN event_id % 7 = 0 THEN concat('readme_', md5(CAST(event_id AS STRING))) WHEN event_id % 7 = 1 THEN concat('run_', upper(md5(CAST(event_id AS STRING)))) WHEN event_id % 2 = 0 THEN concat('run_', md5(CAST(event_id AS STRING))) ELSE concat('sample_', md5(CAST(event_id AS STRING))) END AS run_id,
       ts AS mtime, CASE event_id % 6 WHEN 0 THEN 'label.pdf' WHEN 1 THEN '../escape.pdf' WHEN 2 THEN 'Form.PDF' WHEN 3 THEN 'notes.txt' WHEN 4 THEN '..' ELSE concat('a', CAST(event_id AS STRING), '.pdf') END AS filename,
       CASE event_id % 5 WHEN 0 THEN 'p2_1.png' WHEN 1 THEN 'photo.JPEG' WHEN 2 THEN '../x.png' WHEN 3 THEN 'a b.png' ELSE 'x.gif' END AS image,
       """ + _SIZE + """ AS size_bytes, CASE WHEN event_id % 4 = 0 THEN props ELSE concat('..%PDF-1.7', props) END AS head
FROM {events}
"""


#: Lines of page 1 that name options, and whether a pixel of the page (24 wide, 84 high) is dark: more or less of them by band.
OPTION_LINES = """
SELECT p_partkey AS app_id, 0 AS line_pos, ' WINE' AS text, 20.5 + p_partkey % 3 AS x1, CAST(12 AS DOUBLE) AS y1 FROM {part}
UNION ALL SELECT p_partkey, 1, 'DISTILLED SPIRITS', 20.5, CAST(40 AS DOUBLE) FROM {part}
UNION ALL SELECT p_partkey, 2, 'DISTILLED SPIRITS', 20.5, CAST(30 + p_partkey % 2 AS DOUBLE) FROM {part}
UNION ALL SELECT p_partkey, 3, CASE WHEN p_partkey % 2 = 0 THEN 'MALT BEVERAGES' ELSE 'MALT BEVERAGE' END, 21.25, CAST(50 AS DOUBLE) FROM {part} WHERE p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, 4, 'WINERY', 1.0, CAST(1 AS DOUBLE) FROM {part}
"""


def dark_pixel(x: str, y: str) -> str:
    return f"({x} * 7 + {y} * 11 + p_partkey * 13) % 10 < CASE WHEN {y} < 34 THEN p_size % 8 WHEN {y} < 62 THEN (p_partkey * 3) % 7 ELSE (p_partkey + p_size) % 6 END"


RASTERS = f"SELECT p_partkey AS app_id, 24 AS w, 84 AS h, unhex(array_join(transform(sequence(0, 24 * 84 - 1), i -> CASE WHEN {dark_pixel('(i % 24)', '(i div 24)')} THEN '64' ELSE 'F0' END), '')) AS pixels FROM {{part}}"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of RASTERS. Its rule repeats after ten lines, so each band is cut from a cycle of ten lines, one cycle for each bound.

    Line y of part p is line (y + 3 p) % 10 of the cycle of its band's bound, as 13 p = 3 p and 11 y = y modulo 10.
    """
    cycles = [bytes(0x64 if (x * 7 + y * 11) % 10 < bound else 0xF0 for y in range(10) for x in range(24)) for bound in range(8)]
    cycle = F.array(*(F.lit(c * 5) for c in cycles))
    key, size = F.col("p_partkey"), F.col("p_size")

    def band(bound: Column, begin: int, end: int) -> Column:
        line = F.pmod(begin + 3 * key, F.lit(10)).cast("int")
        return F.substring(F.get(cycle, bound.cast("int")), 24 * line + 1, F.lit(24 * (end - begin)))

    pixels = F.concat(band(size % 8, 0, 34), band((key * 3) % 7, 34, 62), band((key + size) % 6, 62, 84))
    return table(spark, sf_dir, "part").select(key.alias("app_id"), F.lit(24).alias("w"), F.lit(84).alias("h"), pixels.alias("pixels"))


APPS = "SELECT p_partkey AS app_id, concat('application-', CAST(p_partkey AS STRING), '.pdf') AS pdf FROM {part}"

#: The label's two images, and the first page as it is shown; some applications have none.
IMAGES = " UNION ALL ".join(
    f"SELECT p_partkey AS app_id, {i} AS img_pos, 2 AS page, 'p2_{i + 1}.png' AS name, CAST(600 + p_size AS INT) AS width, CAST(400 + p_partkey % 100 AS INT) AS height, concat('/data/', CAST(p_partkey AS STRING), '/p2_{i + 1}.png') AS path, '10 20.5 300 {i}' AS bbox FROM {{part}} WHERE p_partkey % 17 <> 3"
    for i in range(2)
)
RENDERED = "SELECT p_partkey AS app_id, 1 AS page, 'document_p1.png' AS name, 918 AS width, 1188 AS height, concat('/data/', CAST(p_partkey AS STRING), '/document_p1.png') AS path FROM {part} WHERE p_partkey % 17 <> 3"

#: Files of runs: of two images in three, some in another folder.
STORED = """
SELECT concat('file:/srv/runs/', run_id, CASE WHEN n % 5 = 4 THEN '/other/' ELSE '/images/' END, image) AS path
FROM (SELECT *, CAST(size_bytes AS BIGINT) % 10 AS n FROM (""" + RUNS.strip() + """)) WHERE n % 3 <> 0
"""


#: A table's name in braces; a pattern's {14} is none.
_TABLE = r"\{([A-Za-z_]\w*)\}"


def names(sql: str) -> set[str]:
    return set(re.findall(_TABLE, sql))


def for_duckdb(sql: str) -> str:
    return re.sub(_TABLE, r"\1", sql)


#: Tables of few bytes a row that much is made from, and their key.
_DEALT = {"part": "p_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Parts are dealt by their key over as many tasks as there are shuffle partitions.

    A million parts are a file of a few megabytes, which is a task or four, and each becomes forms and label lines of many
    kilobytes. What is made from parts stays dealt by application, so windows, groups and joins on it need no exchange.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _DEALT[name]) if name in _DEALT else rows


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(_SIZE, _SIZE_IN_SPARK), **{n: table(spark, sf_dir, n) for n in names(sql)})
