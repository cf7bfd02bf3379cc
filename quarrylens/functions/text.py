"""Column functions over source text: decoding, masking, names, data set names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of SQL that name no column.
NOT_COLUMNS = """
ALL AND ANY AS ASC AVG BETWEEN BY CASE CAST CHAR CHARACTER CHECK COALESCE
CONCAT CONSTRAINT COUNT CROSS CURRENT CURRENT_DATE CURRENT_TIME
CURRENT_TIMESTAMP DATE DAY DAYS DECIMAL DEFAULT DELETE DESC DIGITS DISTINCT
DOUBLE ELSE END ESCAPE EXISTS FETCH FIRST FLOAT FOR FOREIGN FROM GRAPHIC GROUP
HAVING IN INDICATOR INNER INSERT INTEGER INTO IS JOIN KEY LEFT LENGTH LIKE
LOWER LTRIM MATCHED MAX MERGE MIN MONTH NOT NULL NULLIF ON ONLY OPTIMIZE OR
ORDER OUTER PRIMARY REAL REFERENCES RIGHT ROW ROWS RTRIM SELECT SESSION_USER
SET SMALLINT SOME SQLCODE SQLSTATE SUBSTR SUM THEN TIME TIMESTAMP TRIM UNION
UNIQUE UPDATE UPPER UR USER USING VALUE VALUES VARCHAR WHEN WHERE WITH YEAR
""".split()
#: First words of items of a column list that define no column.
NOT_DEFINITIONS = ["PRIMARY", "FOREIGN", "CONSTRAINT", "UNIQUE", "CHECK", "KEY", "PERIOD", "LIKE", "INCLUDE"]

NAME = r'(?:"[^"\n]+"|[A-Za-z@#$][A-Za-z0-9@#$_]*)'
_NOISE = r"(?s)('[^']*+(?:''[^']*+)*+'|'[^']*+(?:''[^']*+)*+|--[^\n]*|/\*/|/\*.*?(?:\*/|\z)|[^'/\-]+|[\-/])"


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters and line feeds alone as line ends."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\r\n"), F.lit("\n"))
    return F.replace(text, F.lit("\r"), F.lit("\n"))


def masked(text: Column) -> Column:
    """Literals' insides and comments as blanks; length, line ends and quotes stay."""
    blank = lambda x: F.regexp_replace(x, r"[^\n]", " ")
    inside = lambda x, n: F.when(n > 0, blank(F.substring(x, F.lit(2), n))).otherwise("")

    def piece(x: Column) -> Column:
        closed = x.rlike(r"(?s)\A'[^']*+(?:''[^']*+)*+'\z")
        literal = F.when(closed, F.concat(F.lit("'"), inside(x, F.char_length(x) - 2), F.lit("'"))).otherwise(F.concat(F.lit("'"), inside(x, F.char_length(x) - 1)))
        return F.when(x.startswith("'"), literal).when(x.startswith("--") | x.startswith("/*"), blank(x)).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_NOISE), F.lit(1)), piece), "")


def plain_name(part: Column) -> Column:
    """An identifier as compared: delimited ones exactly, without quotes; others in upper case."""
    return F.when(part.startswith('"'), F.replace(part, F.lit('"'), F.lit(""))).otherwise(F.upper(part))


def name_parts(name: Column) -> Column:
    """Parts of a dotted name, each as compared."""
    return F.transform(F.regexp_extract_all(name, F.lit(f"({NAME})"), F.lit(1)), plain_name)


def newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def member_of(path: Column) -> Column:
    """Upper-case base name without extension."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.upper(F.regexp_replace(F.url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", ""))


def library_of(path: Column) -> Column:
    return F.upper(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))


def dsn_parts(dsn: Column) -> Column:
    """struct(base, tail, is_member): LIB(MEM) names a member; a generation like (+1) and &&TEMP do not."""
    bare = F.upper(F.trim(F.replace(dsn, F.lit("'"), F.lit(""))))
    base = F.regexp_extract(bare, r"^([^(]*)", 1)
    inner = F.regexp_extract(bare, r"\(([^)]*)\)", 1)
    member = inner.rlike(r"^[A-Z@#$][A-Z0-9@#$]{0,7}$") & ~bare.startswith("&&")
    return F.struct(base.alias("base"), F.when(member, inner).otherwise(F.element_at(F.split(base, r"\."), -1)).alias("tail"), member.alias("is_member"))
