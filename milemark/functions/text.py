"""Text normalisation, parsing and display expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark.config import NAO_INFORMADO, UF_REGIAO

# Fixed value: the characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

MONEY = "decimal(18,2)"


def norm(c: Column) -> Column:
    """Stripped text with null read as the empty string."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WHITESPACE))


def strip_sql(text: str) -> str:
    """The strip of ``norm`` as SQL text, for plans made of many like columns."""
    chars = "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE)
    return f"btrim({text}, '{chars}')"


def blank_to_null(c: Column) -> Column:
    return F.nullif(norm(c), F.lit(""))


def squish(c: Column) -> Column:
    """Runs of whitespace become one blank, ends are stripped, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)[\s\x{FEFF}]+", " "))


def pick_field(df: DataFrame, *names: str) -> Column:
    """First non-empty value among the named columns that ``df`` has, else ''."""
    present = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(""))


def label_or(c: Column, default: str = NAO_INFORMADO) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def iso_from_text(c: Column) -> Column:
    """``d/m/yy(yy)`` and ``y-m-d...`` become ISO dates, other text is kept stripped."""
    text = norm(c)
    br = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})\z"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    year = F.regexp_extract(text, br, 3)
    br_iso = F.concat_ws(
        "-",
        F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year),
        F.lpad(F.regexp_extract(text, br, 2), 2, "0"),
        F.lpad(F.regexp_extract(text, br, 1), 2, "0"),
    )
    y_m_d = F.concat_ws(
        "-",
        F.regexp_extract(text, iso, 1),
        F.lpad(F.regexp_extract(text, iso, 2), 2, "0"),
        F.lpad(F.regexp_extract(text, iso, 3), 2, "0"),
    )
    return F.when(text.rlike(br), br_iso).when(text.rlike(iso), y_m_d).otherwise(text)


def parse_date(c: Column) -> Column:
    """Strict ``yyyy-MM-dd`` or null."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def num_or_null(c: Column, dtype: str = "bigint") -> Column:
    return blank_to_null(c).try_cast(dtype)


def num_or_zero(c: Column, dtype: str = MONEY) -> Column:
    return F.coalesce(num_or_null(c, dtype), F.lit(0).cast(dtype))


def region_of(uf: Column) -> Column:
    """State to region, unknown states get the default label."""
    pairs = [F.lit(v) for item in UF_REGIAO.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(norm(uf))), F.lit(NAO_INFORMADO))


def label_map(c: Column, labels: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(v) for item in labels.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(c, F.lit(""))), default)


def br_date(c: Column, missing: str = "—") -> Column:
    return F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit(missing))


def br_month(c: Column, missing: str = "—") -> Column:
    return F.coalesce(F.date_format(c, "MM/yyyy"), F.lit(missing))


def br_month_from_code(c: Column) -> Column:
    """``yyyyMM`` text to ``MM/yyyy``; other text is kept, blank becomes a dash."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(text.rlike(r"^\d{6}\z"), F.concat(F.substring(text, 5, 2), F.lit("/"), F.substring(text, 1, 4)))
        .when(text == "", F.lit("—"))
        .otherwise(text)
    )


def br_number(c: Column) -> Column:
    """Two decimals with the point as thousands and the comma as decimal mark."""
    return F.translate(F.format_number(c, 2), ",.", ".,")
