"""Cell functions as native column expressions: no Python runs per row.

Java's classes are ASCII by default while cells are Unicode text, so patterns carry ``(?U)``, and all
decimal digits known to occur in tables are folded to ASCII before a cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what a cell is. They have to equal the established ones.
CJK = "[一-鿿]"
PAREN_RUN = "[（(][^（）()]*[）)]"
MARKS = "[†‡*＊§#※^]+"
NAVBOX = r"(?iU)查\s*论\s*编|\bv\s*t\s*e\b"
NUMBER_TOKEN = r"(?U)\d+(?:\.\d+)?"
STRICT_NUMBER = r"(?U)^([+\-−–])?\s*(\d+(?:\.\d+)?)\s*(%|‰|[a-zA-Z²³/]{0,6}|[一-鿿]{0,3})$"
DATE_PART = r"(?U)\d{1,4}\s*[年月日]|\d{4}[-/.]\d{1,2}|\d{1,2}:\d{2}"
THOUSANDS = r"(?U)(?<=\d)[,，](?=\d{3}\b)"
TOTAL_ROW = (
    "(?iU)^(合计|总计|总和|总数|全国|全国合计|中国大陆|大陆|全省|全市|全区|全州|全盟|全县|平均|小计|其他|其它|总体|世界|全球|"
    "东部|中部|西部|东北|total)$|(总计|合计|小计|平均值|其他|其它)$|^(全省|全市|全国|全区)"
)
KEY_SUFFIXES = ("足球俱乐部", "篮球俱乐部", "俱乐部", "足球队", "篮球队", "代表团", "队")
EDGE = "，,、；;:："
PERIOD_HEADER = r"(?U)^((?:19|20)\d{2})年?(.*)$"
PERIOD_EDGE = " ：:（）()"
MISSING = ("", "—", "-", "–", "N/A", "n/a")

_WIDE_DIGITS = "０１２３４５６７８９"


def text(raw: Column) -> Column:
    return F.coalesce(raw.cast("string"), F.lit(""))


def has_cjk(raw: Column) -> Column:
    return text(raw).rlike(CJK)


def strip(raw: Column) -> Column:
    """Without white space at the ends, any Unicode one."""
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def without_parens(raw: Column) -> Column:
    """Innermost parenthesised runs go until none is left; as many rounds as there are closing marks, and none for text without one."""
    rounds = F.length(F.regexp_replace(raw, "[^）)]", "")) + 1
    cut = F.aggregate(F.sequence(F.lit(1), rounds), raw, lambda x, _: F.regexp_replace(x, PAREN_RUN, ""))
    return F.when(raw.rlike("[）)]"), cut).otherwise(raw)


def entity_key(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(without_parens(text(raw)), NAVBOX, ""), MARKS, "")
    bare = F.regexp_replace(bare, r"(?U)\s+", "")
    return F.regexp_replace(bare, f"^[{EDGE}]+|[{EDGE}]+$", "")


def join_key(raw: Column) -> Column:
    """Entity key without the first suffix of the list that leaves two characters or more."""
    key, out = entity_key(raw), None
    for suffix in KEY_SUFFIXES:
        hit = key.endswith(suffix) & (F.length(key) - len(suffix) >= 2)
        cut = key.substr(F.lit(1), F.length(key) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(key)


def _number_text(raw: Column) -> Column:
    folded = F.translate(F.regexp_replace(strip(text(raw)), MARKS, ""), _WIDE_DIGITS, "0123456789")
    return F.regexp_replace(folded, THOUSANDS, "")


def parse_number(raw: Column) -> Column:
    """The number in a cell that holds exactly one and is no date, score or range; else null."""
    cell = _number_text(raw)
    bare = F.replace(cell, F.lit(" "), F.lit(""))
    good = (cell != "") & ~cell.rlike(DATE_PART) & (F.regexp_count(cell, F.lit(NUMBER_TOKEN)) == 1) & bare.rlike(STRICT_NUMBER)
    value = F.regexp_extract(bare, STRICT_NUMBER, 2).try_cast("double")
    return F.when(good, F.when(F.regexp_extract(bare, STRICT_NUMBER, 1).isin("-", "−", "–"), -value).otherwise(value))


def unit(raw: Column) -> Column:
    """Unit of a strict number, empty where it has none; null for other cells."""
    marked = F.regexp_replace(F.regexp_replace(text(raw), MARKS, ""), THOUSANDS, "")
    bare = F.replace(marked, F.lit(" "), F.lit(""))
    return F.when(bare.rlike(STRICT_NUMBER), F.regexp_extract(bare, STRICT_NUMBER, 3))


def format_number(value: Column, raw: Column) -> Column:
    """The value with as many decimals as the raw cell shows; else none, or two at most."""
    shown = F.length(F.regexp_extract(F.replace(text(raw), F.lit(","), F.lit("")), r"(?U)\d+\.(\d+)", 1))
    own = F.length(F.regexp_extract(value.cast("string"), r"\.(\d+)", 1))
    places = F.when(shown > 0, shown).when(value == F.floor(value), 0).otherwise(F.least(F.lit(2), own))
    return F.replace(F.call_function("format_number", value, places.cast("int")), F.lit(","), F.lit(""))


def period(header: Column) -> Column:
    found = F.regexp_extract(text(header), PERIOD_HEADER, 1)
    return F.when(found != "", F.translate(found, _WIDE_DIGITS, "0123456789").try_cast("int"))


def period_rest(header: Column) -> Column:
    rest = F.regexp_extract(text(header), PERIOD_HEADER, 2)
    return F.btrim(rest, F.lit(PERIOD_EDGE))


def is_total_row(key: Column) -> Column:
    return text(key).rlike(TOTAL_ROW)


def decimals_stated(claim: Column) -> Column:
    """Decimal places of the first decimal number in a statement."""
    return F.length(F.regexp_extract(text(claim), r"\d\.(\d+)", 1))


def quoted(name: str) -> str:
    """An identifier quoted for Spark SQL."""
    return "`" + str(name).replace("`", "``") + "`"
