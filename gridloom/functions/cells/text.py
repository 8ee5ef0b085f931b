"""Text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import define
from gridloom.functions.cells.math import _num, col

lit = F.lit


def text(x) -> Column:
    """A value as text: whole numbers without a fraction, logicals in capitals, blank as nothing."""
    c = col(x)
    s = F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1")
    return F.when(F.typeof(c) == "boolean", F.upper(c.cast("string"))).otherwise(F.coalesce(s, lit("")))


def _int(x) -> Column:
    return F.floor(_num(x)).cast("int")


def wildcard_regex(pattern: Column) -> Column:
    """A pattern with ?, * and ~ as a regular expression."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|/-])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"~\*", "\u0001"), r"~\?", "\u0002"), "~~", "\u0003")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"\*", "[\\\\s\\\\S]*"), r"\?", "[\\\\s\\\\S]"), "\u0001", "\\\\*"), "\u0002", "\\\\?"), "\u0003", "~")


define("LEN")(lambda x: F.char_length(text(x)))
define("LOWER")(lambda x: F.lower(text(x)))
define("UPPER")(lambda x: F.upper(text(x)))
define("TRIM")(lambda x: F.trim(F.regexp_replace(text(x), " +", " ")))
define("CLEAN")(lambda x: F.regexp_replace(text(x), "[\\x00-\\x1F]", ""))
define("LEFT")(lambda x, n=1: F.when(_int(n) >= 0, F.substring(text(x), lit(1), _int(n))))
define("RIGHT")(lambda x, n=1: F.when(_int(n) == 0, "").when(_int(n) > 0, F.right(text(x), _int(n))))
define("MID")(lambda x, at, n: F.when((_int(at) >= 1) & (_int(n) >= 0), F.substring(text(x), _int(at), _int(n))))
define("CONCAT CONCATENATE")(lambda *xs: F.concat(*map(text, xs)))
define("EXACT")(lambda a, b: text(a) == text(b))
define("REPT")(lambda x, n: F.repeat(text(x), _int(n)))
define("FIND")(lambda w, x, at=1: F.nullif(F.call_function("locate", text(w), text(x), _int(at)), lit(0)))
define("SEARCH")(lambda w, x, at=1: F.nullif(F.regexp_instr(F.substring(F.lower(text(x)), _int(at), lit(1 << 30)), wildcard_regex(F.lower(text(w)))), lit(0)) + _int(at) - 1)
define("REPLACE")(lambda x, at, n, new: F.concat(F.substring(text(x), lit(1), _int(at) - 1), text(new), F.substring(text(x), _int(at) + _int(n), lit(1 << 30))))


@define("SUBSTITUTE")
def _substitute(x, old, new, nth=None):
    if nth is None:
        return F.when(text(old) == "", text(x)).otherwise(F.replace(text(x), text(old), text(new)))
    n = _int(nth)
    parts = F.split(text(x), F.concat(lit("\\Q"), text(old), lit("\\E")), -1)
    head = F.concat_ws("\u0001", F.slice(parts, lit(1), n))
    tail = F.concat_ws("\u0001", F.slice(parts, n + 1, F.greatest(F.size(parts) - n, lit(0))))
    mended = F.concat(head, F.when(F.size(parts) > n, F.concat(text(new), tail)).otherwise(""))
    return F.replace(mended, lit("\u0001"), text(old))


define("PROPER")(lambda x: F.array_join(F.transform(F.regexp_extract_all(text(x), lit(r"(\p{L}+|[^\p{L}]+)"), lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, lit(2), F.char_length(w))))), ""))
define("TEXTJOIN")(lambda d, skip, *xs: F.when(col(skip).cast("boolean"), F.call_function("array_join", F.filter(F.array(*map(text, xs)), lambda v: v != ""), text(d))).otherwise(F.call_function("array_join", F.array(*map(text, xs)), text(d))))
define("TEXTSPLIT", "array")(lambda x, cols, rows=None, skip=False: F.transform(F.split(text(x), F.concat(lit("\\Q"), text(rows), lit("\\E")), -1) if rows is not None else F.array(text(x)), lambda line: F.filter(F.split(line, F.concat(lit("\\Q"), text(cols), lit("\\E")), -1), lambda v: (v != "") | ~col(skip))))
define("NUMBERVALUE")(lambda x, d=".", g=",": (lambda t: F.when(t == "", 0.0).otherwise(F.regexp_replace(t, "%", "").try_cast("double") / F.pow(lit(100.0), F.char_length(t) - F.char_length(F.replace(t, lit("%"), lit(""))))))(F.replace(F.replace(F.regexp_replace(text(x), " ", ""), text(g), lit("")), text(d), lit("."))))


@define("VALUE")
def _value(x):
    t = F.trim(text(x))
    plain = F.regexp_replace(F.regexp_replace(t, r"^([-+]?)\$", "$1"), r",(?=\d{3})", "")
    inner = F.regexp_replace(F.regexp_replace(plain, r"^\((.*)\)$", "-$1"), "%$", "")
    return F.when(plain.endswith("%"), inner.try_cast("double") / 100).otherwise(inner.try_cast("double"))


def _fixed(x, d) -> Column:
    from gridloom.functions.cells import call

    v = call("ROUND", x, d)
    return F.when(_int(d) > 0, F.call_function("format_number", v, F.greatest(_int(d), lit(0)))).otherwise(F.format_number(v, 0))


define("FIXED")(lambda x, d=2, plain=False: F.when(col(plain).cast("boolean"), F.replace(_fixed(x, d), lit(","), lit(""))).otherwise(_fixed(x, d)))
define("DOLLAR")(lambda x, d=2: F.when(_num(x) < 0, F.concat(lit("($"), _fixed(F.abs(_num(x)), d), lit(")"))).otherwise(F.concat(lit("$"), _fixed(x, d))))
define("CHAR UNICHAR")(lambda n: F.when((_int(n) > 0) & (_int(n) < 65536), F.decode(F.unhex(F.lpad(F.hex(_int(n)), 4, "0")), "UTF-16BE")))
define("CODE UNICODE")(lambda x: F.conv(F.hex(F.encode(F.substring(text(x), 1, 1), "UTF-32")), 16, 10).cast("long"))
define("ISTHAIDIGIT")(lambda x: text(x).rlike("^[๐-๙]+$"))
define("THAIDIGIT")(lambda x: F.translate(text(x), "0123456789", "๐๑๒๓๔๕๖๗๘๙"))
define("THAISTRINGLENGTH")(lambda x: F.char_length(F.regexp_replace(text(x), r"\p{M}", "")))
define("PHONETIC")(lambda x: text(x))
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
define("ASC")(lambda x: F.translate(text(x), _FULL, _HALF))
define("DBCS JIS")(lambda x: F.translate(text(x), _HALF, _FULL))
_width = lambda x: F.octet_length(F.encode(x, "UTF-8"))


def _dbcs_len(x: Column) -> Column:
    """Bytes in a double-byte code page: two for a character outside ASCII and half-width kana."""
    return F.char_length(x) + F.char_length(F.regexp_replace(x, "[\\x00-\\x7F｡-ﾟ]", ""))


def _cut(x: Column, n: Column) -> Column:
    """The longest head of x that fits n bytes."""
    chars = F.split(x, "")
    end = F.aggregate(chars, F.struct(lit("").alias("s"), lit(0).alias("n"), lit(True).alias("go")), lambda a, c: F.struct(F.when(a["go"] & (a["n"] + _dbcs_len(c) <= n), F.concat(a["s"], c)).otherwise(a["s"]).alias("s"), (a["n"] + _dbcs_len(c)).alias("n"), (a["go"] & (a["n"] + _dbcs_len(c) <= n)).alias("go")))
    return end["s"]


define("LENB")(lambda x: _dbcs_len(text(x)))
define("LEFTB")(lambda x, n=1: _cut(text(x), _int(n)))
define("RIGHTB")(lambda x, n=1: F.reverse(_cut(F.reverse(text(x)), _int(n))))
define("MIDB")(lambda x, at, n: _cut(F.substring(text(x), F.char_length(_cut(text(x), _int(at) - 1)) + 1, lit(1 << 30)), _int(n)))
define("FINDB")(lambda w, x, at=1: F.when(F.call_function("locate", text(w), text(x), lit(1)) > 0, _dbcs_len(F.substring(text(x), lit(1), F.call_function("locate", text(w), text(x), F.char_length(_cut(text(x), _int(at) - 1)) + 1) - 1)) + 1))
define("SEARCHB")(lambda w, x, at=1: F.when(F.lower(text(x)).contains(F.lower(text(w))), _dbcs_len(F.substring(text(x), lit(1), F.call_function("locate", F.lower(text(w)), F.lower(text(x)), F.char_length(_cut(text(x), _int(at) - 1)) + 1) - 1)) + 1))
define("REPLACEB")(lambda x, at, n, new: F.concat(_cut(text(x), _int(at) - 1), text(new), F.substring(text(x), F.char_length(_cut(text(x), _int(at) + _int(n) - 1)) + 1, lit(1 << 30))))
define("HYPERLINK")(lambda url, name=None: text(name if name is not None else url))


def _letters(n: Column) -> Column:
    """A column number as letters."""
    n = n.cast("int")
    a = lambda k: F.substring(lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), k + 1, lit(1))
    one, two = n - 1, n - 27
    three = n - 703
    return F.when(n <= 26, a(one)).when(n <= 702, F.concat(a(F.floor(two / 26).cast("int")), a(two % 26))).otherwise(F.concat(a(F.floor(three / 676).cast("int")), a(F.floor(three / 26).cast("int") % 26), a(three % 26)))


@define("ADDRESS")
def _address(row, column, kind=1, a1=True, sheet=None):
    r, c, k = _int(row), _int(column), _int(kind)
    fixed_r, fixed_c = k.isin(1, 2), k.isin(1, 3)
    if a1:
        out = F.concat(F.when(fixed_c, "$").otherwise(""), _letters(c), F.when(fixed_r, "$").otherwise(""), r.cast("string"))
    else:
        out = F.concat(lit("R"), F.when(fixed_r, r.cast("string")).otherwise(F.concat(lit("["), r.cast("string"), lit("]"))), lit("C"), F.when(fixed_c, c.cast("string")).otherwise(F.concat(lit("["), c.cast("string"), lit("]"))))
    return out if sheet is None else F.concat(text(sheet), lit("!"), out)


@define("TEXT")
def _text_format(x, pattern):
    """Numbers by 0, #, comma, percent and fixed decimals; dates by y m d h s letters. The pattern is a constant."""
    p = str(pattern)
    low = p.lower()
    if any(ch in low for ch in "ymdhs") and not any(ch in p for ch in "0#"):
        java = low.replace("dddd", "EEEE").replace("ddd", "EEE").replace("mmmm", "MMMM").replace("mmm", "MMM")
        out, last = "", ""
        i = 0
        while i < len(java):
            if java[i : i + 2] == "mm":
                out += "mm" if last == "h" or java[i + 2 : i + 4] == ":s" else "MM"
                i += 2
                continue
            c = java[i]
            last = c if c.isalpha() else last
            out += "H" if c == "h" and "am/pm" not in low else "M" if c == "m" else c
            i += 1
        return F.date_format(col(x).cast("timestamp"), out.replace("am/pm", "a"))
    percent = p.count("%")
    body = p.replace("%", "")
    head, _, tail = body.partition(".")
    digits = sum(ch in "0#" for ch in tail)
    least = sum(ch == "0" for ch in head)
    from gridloom.functions.cells import call

    v = call("ROUND", _num(x) * 100**percent, digits)
    whole = F.format_string(f"%,.{digits}f" if "," in head else f"%.{digits}f", F.abs(v))
    if "#" in tail:
        whole = F.regexp_replace(whole, r"\.?0{0," + str(tail.count("#")) + "}$", "") if tail.count("0") == 0 else whole
    padded = F.when(F.char_length(F.substring_index(whole, ".", 1)) < least, F.concat(F.repeat(lit("0"), least - F.char_length(F.substring_index(whole, ".", 1))), whole)).otherwise(whole)
    if least == 0:
        padded = F.regexp_replace(padded, r"^0(?=\.)", "")
    prefix, suffix = ("$" if p.startswith("$") else ""), "%" * percent
    return F.concat(F.when(v < 0, "-").otherwise(""), lit(prefix), padded, lit(suffix))
