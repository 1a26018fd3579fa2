"""Text functions of form checking, as Column expressions that Catalyst sees through.

No Python runs for them. `norm` is the one that everything rests on: it is computed once for each line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------

#: Letters U+00C0 to U+00FF that stand for one base letter, case kept, and those base letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ"
BASE = "AAAAAACEEEEIIIIDNOOOOOOUUUUYaaaaaaceeeeiiiidnoooooouuuuyy"
#: Letters that stand for two.
LIGATURES = {"Æ": "AE", "Þ": "TH", "ß": "ss", "æ": "ae", "þ": "th"}
#: Question texts and the kind of field they ask for; the first that is contained decides, else Admin.
FIELD_KINDS = (
    ("show any wording", "Wording"),
    ("show any information", "Wording"),
    ("brand name", "Brand"),
    ("fanciful name", "Fanciful"),
    ("net contents", "NetContents"),
    ("alcohol content", "Alcohol"),
    ("appellation", "Appellation"),
    ("vintage", "Vintage"),
    ("type of product", "ProductType"),
    ("name and address", "NameAddress"),
)
USED_ON_LABEL = "(used on label)"
NUMBER = r"(\d+(?:\.\d+)?)"
TTB_ID = r"(?i)TTB ID\s*\n?\s*(\d{6,20})"
BARE_TTB_ID = r"\b(\d{14})\b"
RUN_ID = "^(?:run|sample)_[0-9a-f]{32}$"
IMAGE_NAME = r"(?i)^[A-Za-z0-9_.-]+\.(?:png|jpe?g)$"

_BREAK = "\x02"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z; other letters stay as they are. A text of ASCII has no others, and Spark's lower is far quicker than a table of letters."""
    c = column(c)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def trim(c: Column | str) -> Column:
    """Without spaces, tabs, carriage returns and line ends at either end."""
    return F.btrim(column(c), F.lit(" \t\r\n"))


def norm(c: Column | str) -> Column:
    """Lower-cased words of letters and digits, one space between; accents give way to (case-kept) base letters, and any
    other character beyond ASCII to the letter a, with a word of its own beginning before it."""
    c = column(c)
    plain = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))
    full = F.translate(c, string.ascii_uppercase + _BREAK, string.ascii_lowercase + " ")
    full = F.regexp_replace(full, "[̀-ͯ×÷]", "")
    for ligature, letters in LIGATURES.items():
        full = F.replace(full, F.lit(ligature), F.lit(letters))
    full = F.translate(full, ACCENTED, BASE)
    full = F.regexp_replace(full, "([A-Za-z0-9])([^A-Za-z0-9])", f"$1{_BREAK}$2")
    full = F.regexp_replace(full, r"[\x00\x01\x03-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", "")
    full = F.regexp_replace(full, r"[^\x00-\x7F]", "a")
    full = F.rtrim(F.translate(full, _BREAK, " "))
    return F.when(F.octet_length(c) == F.char_length(c), plain).otherwise(full)


def compact(normed: Column | str) -> Column:
    """A normalised text without its spaces."""
    return F.replace(column(normed), F.lit(" "), F.lit(""))


def before_last(c: Column | str, mark: str) -> Column:
    """The text before the last occurrence of mark (given in lower case, matched in either case); null if it is absent."""
    c = column(c)
    reversed_at = F.locate(mark[::-1], F.reverse(ascii_lower(c)))
    return F.when(reversed_at > 0, F.substring(c, F.lit(1), F.char_length(c) - (reversed_at - 1) - len(mark)))


def first_number(c: Column | str) -> Column:
    """The first number as it is written; empty if there is none."""
    return F.regexp_extract(column(c), NUMBER, 1)


def ttb_id(page: Column | str) -> Column:
    page = column(page)
    found = [F.nullif(F.regexp_extract(page, pattern, 1), F.lit("")) for pattern in (TTB_ID, BARE_TTB_ID)]
    return F.coalesce(*found, F.lit(""))


def field_kind(question: Column | str) -> Column:
    low = ascii_lower(question)
    kind = None
    for text, name in FIELD_KINDS:
        here = F.contains(low, F.lit(text))
        kind = F.when(here, name) if kind is None else kind.when(here, name)
    return kind.otherwise("Admin")


def overlap(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """Shared area over the smaller area; 0 for boxes apart."""
    width = F.greatest(F.lit(0), F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2))
    height = F.greatest(F.lit(0), F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2))
    shared = width.cast("double") * height
    return F.when(shared > 0, shared / F.least(w1.cast("double") * h1, w2.cast("double") * h2)).otherwise(0.0)


def pdf_name_error(name: Column | str) -> Column:
    """Why a file name is refused; null if it is fine."""
    name = column(name)
    unsafe = name.isNull() | name.isin("", ".", "..") | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\"))
    return F.when(unsafe, "invalid file name").when(~F.endswith(ascii_lower(name), F.lit(".pdf")), "only PDF files are accepted")


# --- the same rules in DuckDB's SQL -------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ascii_lower_sql(c: str) -> str:
    return f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def norm_sql(c: str) -> str:
    full = f"translate({c}, '{string.ascii_uppercase}' || chr(2), '{string.ascii_lowercase} ')"
    full = f"regexp_replace({full}, '[̀-ͯ×÷]', '', 'g')"
    for ligature, letters in LIGATURES.items():
        full = f"replace({full}, '{ligature}', '{letters}')"
    full = f"translate({full}, '{ACCENTED}', '{BASE}')"
    full = f"regexp_replace({full}, '([A-Za-z0-9])([^A-Za-z0-9])', '\\1' || chr(2) || '\\2', 'g')"
    full = f"regexp_replace({full}, '[\\x00\\x01\\x03-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')"
    full = f"regexp_replace({full}, '[^\\x00-\\x7F]', 'a', 'g')"
    return f"rtrim(translate({full}, chr(2), ' '))"


def field_kind_sql(c: str) -> str:
    rules = " ".join(f"WHEN contains({ascii_lower_sql(c)}, '{text}') THEN '{name}'" for text, name in FIELD_KINDS)
    return f"CASE {rules} ELSE 'Admin' END"


def before_last_sql(c: str, mark: str) -> str:
    at = f"instr(reverse({ascii_lower_sql(c)}), '{mark[::-1]}')"
    return f"CASE WHEN {at} > 0 THEN substr({c}, 1, length({c}) - ({at} - 1) - {len(mark)}) END"
