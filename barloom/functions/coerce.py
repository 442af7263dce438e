"""Null-safe coercions and small parsers of scalar texts, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for true, false and nothing, and the factors of magnitude suffixes.
TRUE, FALSE = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")
NOTHING = ("none", "n/a", "na", "unknown", "—", "-", "")
MAGNITUDES = {"T": 1e12, "B": 1e9, "M": 1e6, "K": 1e3}


def safe_float(x: Column) -> Column:
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_int(x: Column) -> Column:
    return F.when(F.abs(safe_float(x)) < 9.2e18, safe_float(x).try_cast("bigint"))


def safe_str(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def safe_bool(x: Column) -> Column:
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def no_sentinel(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*NOTHING), F.trim(x))


def clamped(x: Column, most: float = 1000) -> Column:
    return F.when(F.abs(x) <= most, x)


def inverted(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.nullif(x, F.lit(0.0)))


def magnitude(x: Column) -> Column:
    """'1.5B' to 1.5e9; '--' and what is no number to null."""
    bare = F.regexp_replace(F.trim(x), "[$,]", "")
    factor = F.try_element_at(F.create_map(*[F.lit(v) for pair in MAGNITUDES.items() for v in pair]), F.upper(F.substring(bare, -1, 1)))
    return F.coalesce(F.regexp_replace(bare, "[TBMKtbmk]$", "").try_cast("double") * factor, bare.try_cast("double"))


def contract_expiry(symbol: Column) -> Column:
    """The expiry of an option's symbol (root, yymmdd, C or P, strike), as a date."""
    day = F.nullif(F.regexp_extract(symbol, r"^[A-Z]+(\d{6})[CP]\d+$", 1), F.lit(""))
    return F.concat(F.lit("20"), F.substring(day, 1, 2), F.lit("-"), F.substring(day, 3, 2), F.lit("-"), F.substring(day, 5, 2)).try_cast("date")


def is_isin(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), F.lit(False))


#: Whole words of an event's name and its unit, in this order; the first rule that has one holds.
UNITS = (
    ("YY|MM|QQ", "percent"),
    ("PMI|Sentiment|Confidence|Conditions|Expectations|Index|ISM|ZEW|IFO|Tankan|Manheim", "index_level"),
    ("CPI|PPI|Infl|Inflation|Wage|Earnings|Yield", "percent"),
    ("Payrolls|Claims|NFP|Hiring|Vacancies|Job|Jobless", "thousands"),
    ("Trade Balance|Current Account|Budget|Deficit|Reserves|Money Supply|M[0-9]|Loan", "currency"),
    ("Rate Decision|Policy Rate|Funds Rate|Repo|Bank Rate|GDP", "percent"),
)


def unit_of(name: Column) -> Column:
    """The unit that an event's name tells; null if no rule knows it."""
    return F.coalesce(*[F.when(name.rlike(rf"(?i)\b(?:{words})\b"), unit) for words, unit in UNITS])


#: Entities by name; numbered ones are read by their number.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"))


def _entities(text: Column) -> Column:
    """Entities as characters: named, decimal and hexadecimal ones; & itself last, so that none is read twice."""
    whole = F.split(F.regexp_replace(text, r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});", "\u0001$1\u0002"), "\u0001")
    code = lambda e: F.when(F.lower(F.substring(e, 1, 1)) == "x", F.conv(F.substring(e, 2, 9), 16, 10)).otherwise(e).cast("int")
    read = lambda part: F.concat(_char(code(F.substring_index(part, "\u0002", 1))), F.substring_index(part, "\u0002", -1))
    t = F.array_join(F.transform(whole, lambda part: F.when(F.instr(part, "\u0002") > 0, read(part)).otherwise(part)), "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def _char(code: Column) -> Column:
    """The character of a code point: chr() knows but the first 256, so it is decoded from its four bytes."""
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def plain_text(html: Column) -> Column:
    """HTML to text: paragraphs become blank lines, links [text](address), code blocks fenced lines that keep their white
    space; other tags go and entities are read."""
    code = r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>"
    # Parts alternate between text and code, so nothing that happens to text touches code.
    parts = F.split(F.regexp_replace(html, code, "\u0003$1\u0004"), "\u0003")

    def prose(t: Column) -> Column:
        t = F.regexp_replace(t, r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
        t = F.regexp_replace(F.regexp_replace(t, r"(?i)<p[^>]*>|</p>|<br\s*/?>\s*<br\s*/?>", "\n\n"), r"(?i)<br\s*/?>", "\n")
        return _entities(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"\n{3,}", "\n\n"))

    def part(p: Column) -> Column:
        block, after = F.substring_index(p, "\u0004", 1), F.substring_index(p, "\u0004", -1)
        fenced = F.concat(F.lit("\n```\n"), _entities(F.regexp_replace(block, r"^\n+|\n+$", "")), F.lit("\n```\n"), prose(after))
        return F.when(F.instr(p, "\u0004") > 0, fenced).otherwise(prose(p))

    return F.regexp_replace(F.array_join(F.transform(parts, part), ""), r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def snake(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"[^A-Za-z0-9]+", "_"), "^_|_$", ""))


def routed(label: Column, table: dict[str, str]) -> Column:
    """The field of the longest prefix in ``table`` that a label starts with."""
    out = F.lit(None).cast("string")
    for prefix in sorted(table, key=lambda p: (len(p), p)):
        out = F.when(F.lower(label).startswith(prefix.lower()), table[prefix]).otherwise(out)
    return out


def sparkline(values: Column) -> Column:
    """An array of numbers as eight block heights scaled to their own range; null is a dot, a flat series the middle."""
    lo, hi = F.array_min(F.filter(values, lambda x: x.isNotNull())), F.array_max(F.filter(values, lambda x: x.isNotNull()))
    blocks = F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"])
    level = lambda x: F.when(hi == lo, 4).otherwise(F.least(F.floor((x - lo) / (hi - lo) * 8), F.lit(7)) + 1).cast("int")
    return F.array_join(F.transform(values, lambda x: F.when(x.isNull(), "·").otherwise(F.get(blocks, level(x) - 1))), "")
