"""Wide queries of cell functions: many functions over the columns of one table, each beside its SQL.

Numbers are compared as doubles, rounded to DIGITS decimals. Inverses of
distributions are undone by the distribution, or taken where a closed form is
known (two degrees of freedom, a shape of 1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.cells import call
from gridloom.plans.catalog import register, table

c = F.col
DIGITS = 7
_N = "n"


def _shown(column, kind: str):
    return F.round(column.cast("double"), DIGITS) + 0.0 if kind == "n" else column.cast("string") if kind == "s" else column


def _sql(expression: str, kind: str) -> str:
    return f"round(({expression})::double, {DIGITS}) + 0.0" if kind == "n" else f"({expression})::varchar" if kind == "s" else expression


def _wide(name: str, source: str, keys: list[str], made, prepared: dict[str, str] | None = None, arrays: dict[str, str] | None = None):
    """Scalars: made gives (output, kind, function, arguments, SQL); prepared adds columns, in the SQL that both engines read; arrays adds some that the SQL does not name."""
    listed = made()
    inner = ", ".join(["*", *(f"{e} AS {n}" for n, e in (prepared or {}).items())])
    shown = ", ".join([*keys, *(f"{_sql(s, kind)} AS {out}" for out, kind, _, _, s in listed)])

    @register(name, f"SELECT {shown} FROM (SELECT {inner} FROM {source})")
    def run(spark, sf):
        df = table(spark, sf, source).selectExpr("*", *(f"{e} AS {n}" for n, e in ((prepared or {}) | (arrays or {})).items()))
        return df.select(*keys, *[_shown(call(f, *(a() if callable(a) else a)), kind).alias(out) for out, kind, f, a, _ in listed])


def _grouped(name: str, source: str, keys: list[str], made):
    listed = made()
    shown = ", ".join([*keys, *(f"{_sql(s, 'n')} AS {out}" for out, _, _, s in listed)])

    @register(name, f"SELECT {shown} FROM {source} GROUP BY {', '.join(keys)}")
    def run(spark, sf):
        out = table(spark, sf, source).groupBy(*keys).agg(*[call(f, *(a() if callable(a) else a)).alias(n) for n, f, a, _ in listed])
        return out.select(*keys, *[_shown(c(n), "n").alias(n) for n, *_ in listed])


def _x(*more):
    return lambda: (c("x"), *more)


def _one(f, s):
    return (f.lower().replace(".", "_").replace("/", "_"), "n", f, _x(), s)


_wide("fx_trigonometry", "part", ["p_partkey"], lambda: [
    _one("SIN", "sin(x)"), _one("COS", "cos(x)"), _one("TAN", "tan(x)"), _one("SEC", "1/cos(x)"), _one("CSC", "1/sin(x)"), _one("COT", "1/tan(x)"),
    _one("SINH", "sinh(x)"), _one("COSH", "cosh(x)"), _one("TANH", "tanh(x)"), _one("SECH", "1/cosh(x)"), _one("CSCH", "1/sinh(x)"), _one("COTH", "cosh(x)/sinh(x)"),
    _one("ATAN", "atan(x)"), _one("ACOT", "pi()/2-atan(x)"), _one("ASINH", "asinh(x)"), _one("EXP", "exp(x)"), _one("DEGREES", "degrees(x)"), _one("RADIANS", "radians(x)"),
    ("acosh", "n", "ACOSH", lambda: (c("x") + 1,), "acosh(x+1)"), ("acoth", "n", "ACOTH", lambda: (c("x") + 1,), "0.5*ln((x+2)/x)"), ("atan2", "n", "ATAN2", lambda: (c("x"), c("y")), "atan2(y,x)"),
    ("acos", "n", "ACOS", lambda: (c("y"),), "acos(y)"), ("asin", "n", "ASIN", lambda: (c("y"),), "asin(y)"), ("atanh", "n", "ATANH", lambda: (c("y"),), "atanh(y)"), ("fisher", "n", "FISHER", lambda: (c("y"),), "atanh(y)"),
    _one("FISHERINV", "tanh(x)"), ("pi", "n", "PI", (), "pi()"), ("none", "n", "ACOS", lambda: (c("x") + 1,), "NULL"),
], {"x": "p_size / 2e1", "y": "p_size / 5.1e1"})

_wide("fx_rounding", "customer", ["c_custkey"], lambda: [
    _one("ABS", "abs(x)"), _one("INT", "floor(x)"), _one("SIGN", "sign(x)"), _one("EVEN", "sign(x)*ceil(abs(x)/2)*2"), _one("ODD", "CASE WHEN x=0 THEN 1 ELSE sign(x)*(ceil((abs(x)+1)/2)*2-1) END"),
    ("trunc", "n", "TRUNC", _x(), "trunc(x)"), ("roundup", "n", "ROUNDUP", _x(), "sign(x)*ceil(abs(x))"), ("rounddown", "n", "ROUNDDOWN", _x(), "trunc(x)"), ("quotient", "n", "QUOTIENT", _x(7), "trunc(x/7)"),
    ("mround", "n", "MROUND", lambda: (F.abs(c("x")), 5), "floor(abs(x)/5+0.5)*5"), ("cp", "n", "CEILING.PRECISE", _x(3), "ceil(x/3)*3"), ("ic", "n", "ISO.CEILING", _x(3), "ceil(x/3)*3"), ("fp", "n", "FLOOR.PRECISE", _x(3), "floor(x/3)*3"),
    ("cm", "n", "CEILING.MATH", _x(3, 1), "sign(x)*ceil(abs(x)/3)*3"), ("fm", "n", "FLOOR.MATH", _x(3, 1), "sign(x)*floor(abs(x)/3)*3"), ("iseven", "b", "ISEVEN", _x(), "trunc(abs(x))::bigint % 2 = 0"), ("isodd", "b", "ISODD", _x(), "trunc(abs(x))::bigint % 2 = 1"),
    _one("ROUNDBAHTDOWN", "trunc(x*4)/4"), _one("ROUNDBAHTUP", "sign(x)*ceil(abs(x)*4)/4"),
], {"x": "c_acctbal"})

_wide("fx_powers", "part", ["p_partkey"], lambda: [
    ("power", "n", "POWER", _x(1.5), "pow(x,1.5)"), _one("SQRT", "sqrt(x)"), _one("SQRTPI", "sqrt(x*pi())"), _one("LN", "ln(x)"), ("log", "n", "LOG", _x(3), "ln(x)/ln(3)"), _one("LOG10", "log10(x)"), _one("FACT", "factorial(x::int)::double"),
    _one("FACTDOUBLE", "list_reduce(list_transform(range(x::bigint, 0, -2), lambda v: v::double), lambda a, b: a * b)"), ("combin", "n", "COMBIN", lambda: (20, c("x")), "gamma(21)/gamma(x+1)/gamma(21-x)"), ("combina", "n", "COMBINA", _x(3), "x*(x+1)*(x+2)/6"),
    ("permut", "n", "PERMUT", lambda: (20, 3), "20*19*18"), ("permutationa", "n", "PERMUTATIONA", _x(2), "x*x"), ("gcd", "n", "GCD", _x(12, 18), "gcd(gcd(x::bigint,12),18)"), ("lcm", "n", "LCM", _x(6), "lcm(x::bigint,6)"),
    ("multinomial", "n", "MULTINOMIAL", _x(1, 1), "(x+2)*(x+1)"), ("delta", "n", "DELTA", _x(7), "(x=7)::int"), ("gestep", "n", "GESTEP", _x(7), "(x>=7)::int"), ("standardize", "n", "STANDARDIZE", _x(4, 2), "(x-4)/2"), ("n", "n", "N", _x(), "x"),
    ("phi", "n", "PHI", _x(), "exp(-x*x/2)/sqrt(2*pi())"), ("series", "n", "SERIESSUM", lambda: (c("x") / 10, 1, 2, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), "x/10+2*pow(x/10,3)+3*pow(x/10,5)"), ("gamma", "n", "GAMMA", lambda: (c("x") / 2,), "gamma(x/2)"), ("gammaln", "n", "GAMMALN", _x(), "lgamma(x)"), ("gammaln2", "n", "GAMMALN.PRECISE", _x(), "lgamma(x)"),
], {"x": "cast(p_size % 15 + 1 AS double)"})

_wide("fx_bases", "part", ["p_partkey"], lambda: [
    ("dec2bin", "s", "DEC2BIN", _x(), "to_base(x, 2)"), ("dec2oct", "s", "DEC2OCT", _x(), "to_base(x, 8)"), ("dec2hex", "s", "DEC2HEX", _x(4), "lpad(to_base(x, 16), 4, '0')"),
    *[(f"{f.lower()}2{t.lower()}", "s", f"{f}2{t}", lambda b=b: (F.conv(c("x").cast("string"), 10, b),), f"to_base(x, {d})") for f, b in (("BIN", 2), ("OCT", 8), ("HEX", 16)) for t, d in (("BIN", 2), ("OCT", 8), ("HEX", 16)) if f != t],
    *[(f"{f.lower()}2dec", "n", f"{f}2DEC", lambda b=b: (F.conv(c("x").cast("string"), 10, b),), "x") for f, b in (("BIN", 2), ("OCT", 8), ("HEX", 16))],
    ("base", "s", "BASE", _x(7), "to_base(x, 7)"), ("decimal", "n", "DECIMAL", lambda: (F.conv(c("x").cast("string"), 10, 7), 7), "x"), ("bitand", "n", "BITAND", _x(85), "x & 85"), ("bitor", "n", "BITOR", _x(85), "x | 85"), ("bitxor", "n", "BITXOR", _x(85), "xor(x, 85)"),
    ("bitlshift", "n", "BITLSHIFT", _x(3), "x << 3"), ("bitrshift", "n", "BITRSHIFT", _x(2), "x >> 2"),
], {"x": "p_partkey % 500 + 1"})

_NUMBER_ERR = "CASE WHEN o_orderstatus='F' THEN '#N/A' WHEN o_orderstatus='O' THEN '#DIV/0!' END"
_wide("fx_information", "orders", ["o_orderkey"], lambda: [
    ("a", "b", "AND", lambda: (c("o_totalprice") > 100000, c("o_orderstatus") == "O"), "o_totalprice>100000 AND o_orderstatus='O'"), ("o", "b", "OR", lambda: (c("o_totalprice") > 100000, c("o_orderstatus") == "O"), "o_totalprice>100000 OR o_orderstatus='O'"),
    ("nt", "b", "NOT", lambda: (c("o_totalprice") > 100000,), "NOT o_totalprice>100000"), ("xr", "b", "XOR", lambda: (c("o_totalprice") > 100000, c("o_orderstatus") == "O"), "(o_totalprice>100000) <> (o_orderstatus='O')"),
    ("i", "s", "IF", lambda: (c("o_totalprice") > 100000, "high", "low"), "CASE WHEN o_totalprice>100000 THEN 'high' ELSE 'low' END"), ("ifna", "s", "IFNA", lambda: (c("e"), "none"), "CASE WHEN o_orderstatus='O' THEN '#DIV/0!' ELSE 'none' END"), ("iferror", "n", "IFERROR", lambda: (F.nullif(c("o_custkey"), F.lit(1)), -1), "coalesce(nullif(o_custkey,1),-1)"),
    ("t", "b", "TRUE", (), "true"), ("f", "b", "FALSE", (), "false"), ("na", "s", "NA", (), "'#N/A'"), ("blank", "b", "ISBLANK", lambda: (c("e"),), "e IS NULL"), ("isna", "b", "ISNA", lambda: (c("e"),), "coalesce(e='#N/A',false)"), ("iserr", "b", "ISERR", lambda: (c("e"),), "coalesce(e='#DIV/0!',false)"), ("iserror", "b", "ISERROR", lambda: (c("e"),), "e IS NOT NULL"),
    ("isnumber", "b", "ISNUMBER", lambda: (c("o_totalprice"),), "o_totalprice IS NOT NULL"), ("istext", "b", "ISTEXT", lambda: (c("o_orderstatus"),), "o_orderstatus IS NOT NULL"), ("isnontext", "b", "ISNONTEXT", lambda: (c("o_totalprice"),), "true"), ("islogical", "b", "ISLOGICAL", lambda: (c("o_totalprice") > 5,), "o_totalprice IS NOT NULL"),
    ("kind", "n", "ERROR.TYPE", lambda: (c("e"),), "CASE e WHEN '#N/A' THEN 7 WHEN '#DIV/0!' THEN 2 END"), ("ty", "n", "TYPE", lambda: (c("o_orderstatus"),), "2"), ("tt", "s", "T", lambda: (c("o_orderstatus"),), "o_orderstatus"), ("ch", "s", "CHOOSE", lambda: (c("o_custkey") % 3 + 1, "x", "y", "z"), "['x','y','z'][o_custkey % 3 + 1]"), ("om", "b", "ISOMITTED", (), "true"),
], {"e": _NUMBER_ERR})

_wide("fx_text_more", "customer", ["c_custkey"], lambda: [
    ("low", "s", "LOWER", lambda: (c("c_name"),), "lower(c_name)"), ("cc", "s", "CONCAT", lambda: (c("c_name"), "/", c("c_mktsegment")), "c_name || '/' || c_mktsegment"), ("cd", "s", "CONCATENATE", lambda: (c("c_mktsegment"), c("c_name")), "c_mktsegment || c_name"), ("ex", "b", "EXACT", lambda: (c("c_mktsegment"), "BUILDING"), "c_mktsegment='BUILDING'"),
    ("lb", "s", "LEFTB", lambda: (c("c_name"), 4), "left(c_name,4)"), ("rb", "s", "RIGHTB", lambda: (c("c_name"), 4), "right(c_name,4)"), ("mb", "s", "MIDB", lambda: (c("c_name"), 3, 5), "substring(c_name,3,5)"), ("nb", "n", "LENB", lambda: (c("c_name"),), "length(c_name)"), ("fb", "n", "FINDB", lambda: ("#", c("c_name")), "strpos(c_name,'#')"),
    ("sb", "n", "SEARCHB", lambda: ("OMER", c("c_name")), "strpos(lower(c_name),'omer')"), ("se", "n", "SEARCH", lambda: ("t?m", c("c_name")), "strpos(lower(c_name),'tom')"), ("rp", "s", "REPLACE", lambda: (c("c_name"), 2, 3, "--"), "left(c_name,1) || '--' || substring(c_name,5)"), ("rpb", "s", "REPLACEB", lambda: (c("c_name"), 2, 3, "--"), "left(c_name,1) || '--' || substring(c_name,5)"),
    ("pr", "s", "PROPER", lambda: (c("c_mktsegment"),), "left(c_mktsegment,1) || lower(substring(c_mktsegment,2))"), ("cl", "s", "CLEAN", lambda: (F.concat(c("c_name"), F.lit("\n\t")),), "c_name"), ("va", "n", "VALUE", lambda: (F.right(c("c_name"), F.lit(5)),), "right(c_name,5)::double"), ("nv", "n", "NUMBERVALUE", lambda: (F.concat(F.lit("1.000,"), F.right(c("c_name"), F.lit(2))), ",", "."), "1000 + right(c_name,2)::double/100"),
    ("db", "s", "DBCS", lambda: ("a1",), "'ａ１'"), ("as", "s", "ASC", lambda: ("ａ１",), "'a1'"), ("th", "s", "THAIDIGIT", lambda: (F.lit(12),), "'๑๒'"), ("ith", "b", "ISTHAIDIGIT", lambda: ("๑๒",), "true"), ("tl", "n", "THAISTRINGLENGTH", lambda: (c("c_name"),), "length(c_name)"), ("hy", "s", "HYPERLINK", lambda: ("http://a.b", c("c_name")), "c_name"), ("ph", "s", "PHONETIC", lambda: (c("c_name"),), "c_name"),
])

_wide("fx_dates_more", "orders", ["o_orderkey"], lambda: [
    ("dy", "n", "DAY", lambda: (c("d"),), "day(d)"), ("ds", "n", "DAYS", lambda: (F.lit("2000-01-01").cast("date"), c("d")), "DATE '2000-01-01' - d"), ("wk", "n", "ISOWEEKNUM", lambda: (c("d"),), "weekofyear(d)"), ("wk2", "n", "ISO.WEEKNUM", lambda: (c("d"),), "weekofyear(d)"), ("wn", "n", "WEEKNUM", lambda: (c("d"), 21), "weekofyear(d)"),
    ("dt", "d", "DATE", lambda: (F.year(c("d")), F.month(c("d")) + 1, 1), "(date_trunc('month', d) + INTERVAL 1 MONTH)::date"), ("dd", "n", "DATEDIF", lambda: (F.lit("1990-01-01").cast("date"), c("d"), "D"), "d - DATE '1990-01-01'"), ("dm", "n", "DATEDIF", lambda: (F.lit("1990-01-01").cast("date"), c("d"), "M"), "(year(d)-1990)*12+month(d)-1"), ("dyy", "n", "DATEDIF", lambda: (F.lit("1990-01-01").cast("date"), c("d"), "Y"), "year(d)-1990"),
    ("d360", "n", "DAYS360", lambda: (F.lit("1990-01-15").cast("date"), c("d")), "(year(d)-1990)*360+(month(d)-1)*30+day(d)-15"), ("ti", "n", "TIME", lambda: (F.dayofmonth(c("d")) % 24, 30, 15), "((day(d) % 24)*3600+30*60+15)/86400.0"), ("tv", "n", "TIMEVALUE", lambda: (F.concat(F.lpad((F.dayofmonth(c("d")) % 24).cast("string"), 2, "0"), F.lit(":30:00")),), "((day(d) % 24)*3600+1800)/86400.0"), ("dv", "n", "DATEVALUE", lambda: (c("d").cast("string"),), "d - DATE '1899-12-30'"),
    ("wi", "n", "NETWORKDAYS.INTL", lambda: (c("d"), F.date_add(c("d"), 6), 1), "5"), ("wd", "d", "WORKDAY", lambda: (c("d"), 5), "d + CASE isodow(d) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END::int"),
], {"d": "cast(o_orderdate AS date)"})
_wide("fx_times", "events", ["event_id"], lambda: [("h", "n", "HOUR", lambda: (c("ts"),), "hour(ts)"), ("m", "n", "MINUTE", lambda: (c("ts"),), "minute(ts)"), ("s", "n", "SECOND", lambda: (c("ts"),), "floor(second(ts))")])

_G = "pow(1.01, 24)"
_wide("fx_finance_more", "part", ["p_partkey"], lambda: [
    ("pv", "n", "PV", lambda: (0.01, 24, c("x")), f"-x*(1-1/{_G})/0.01"), ("fv", "n", "FV", lambda: (0.01, 24, c("x")), f"-x*({_G}-1)/0.01"), ("nper", "n", "NPER", lambda: (0.01, -c("x"), c("x") * 10), "-ln(1-10*0.01)/ln(1.01)"), ("ipmt", "n", "IPMT", lambda: (0.01, 1, 24, c("x")), "-x*0.01"), ("ppmt", "n", "PPMT", lambda: (0.01, 1, 24, c("x")), f"-x*{_G}*0.01/({_G}-1)+x*0.01"),
    ("ispmt", "n", "ISPMT", lambda: (0.01, 3, 24, c("x")), "-x*0.01*(1-3/24.0)"), ("sln", "n", "SLN", lambda: (c("x"), 100, 7), "(x-100)/7"), ("syd", "n", "SYD", lambda: (c("x"), 100, 7, 2), "(x-100)*6*2/56"), ("ddb", "n", "DDB", lambda: (c("x"), 1, 10, 1), "x*0.2"), ("effect", "n", "EFFECT", lambda: (c("x") / 10000, 4), "pow(1+x/40000,4)-1"), ("nominal", "n", "NOMINAL", lambda: (c("x") / 10000, 4), "(pow(1+x/10000,0.25)-1)*4"),
    ("rri", "n", "RRI", lambda: (5, 100, c("x")), "pow(x/100,0.2)-1"), ("pd", "n", "PDURATION", lambda: (0.05, 100, c("x")), "(ln(x)-ln(100))/ln(1.05)"), ("fvs", "n", "FVSCHEDULE", lambda: (c("x"), F.array(F.lit(0.1), F.lit(0.2))), "x*1.1*1.2"), ("cumi", "n", "CUMIPMT", lambda: (0.01, 24, c("x"), 1, 1), "-x*0.01"), ("cump", "n", "CUMPRINC", lambda: (0.01, 24, c("x"), 1, 24), "-x"),
    ("de", "n", "DOLLARDE", lambda: (F.lit(1.02), 16), "1.125"), ("dfr", "n", "DOLLARFR", lambda: (F.lit(1.125), 16), "1.02"), ("rate", "n", "RATE", lambda: (24, -c("x"), call("PV", 0.02, 24, -c("x"))), "0.02"),
    ("disc", "n", "DISC", lambda: (c("s"), c("m"), 97, 100, 2), "0.03/(180/360.0)"), ("intrate", "n", "INTRATE", lambda: (c("s"), c("m"), 1000, c("x") + 1000, 2), "x/1000/0.5"), ("received", "n", "RECEIVED", lambda: (c("s"), c("m"), c("x"), 0.05, 2), "x/(1-0.05*0.5)"), ("pricedisc", "n", "PRICEDISC", lambda: (c("s"), c("m"), 0.05, c("x"), 2), "x*(1-0.05*0.5)"), ("yielddisc", "n", "YIELDDISC", lambda: (c("s"), c("m"), 97, 100, 2), "(100/97.0-1)/0.5"),
    ("accrintm", "n", "ACCRINTM", lambda: (c("s"), c("m"), 0.1, c("x"), 2), "x*0.1*0.5"), ("bp", "n", "TBILLPRICE", lambda: (c("s"), c("m"), 0.05), "100*(1-0.05*180/360)"), ("by_", "n", "TBILLYIELD", lambda: (c("s"), c("m"), 97), "3/97.0*2"), ("be", "n", "TBILLEQ", lambda: (c("s"), c("m"), 0.05), "365*0.05/(360-0.05*180)"),
    ("pm", "n", "PRICEMAT", lambda: (c("s"), c("m"), c("s"), 0.1, 0.1, 2), "100"), ("ym", "n", "YIELDMAT", lambda: (c("s"), c("m"), c("s"), 0.1, 100, 2), "0.1"), ("pr", "n", "PRICE", lambda: (c("s"), F.date_add(c("s"), 365), 0.08, 0.08, 100, 1, 0), "100"), ("yl", "n", "YIELD", lambda: (c("s"), F.date_add(c("s"), 365), 0.08, 100, 100, 1, 0), "0.08"),
], {"x": "p_retailprice", "s": "CAST('2021-01-01' AS date)", "m": "CAST('2021-06-30' AS date)"})

_wide("fx_distributions", "part", ["p_partkey"], lambda: [
    ("norm", "n", "NORM.INV", lambda: (call("NORM.DIST", c("x"), 1, 2, True), 1, 2), "x"), ("norm2", "n", "NORMINV", lambda: (call("NORMDIST", c("x"), 1, 2, True), 1, 2), "x"), ("norms", "n", "NORM.S.INV", lambda: (call("NORM.S.DIST", c("x"), True),), "x"), ("norms2", "n", "NORMSINV", lambda: (call("NORMSDIST", c("x")),), "x"), ("npdf", "n", "NORM.DIST", lambda: (c("x"), 1, 2, False), "exp(-pow((x-1)/2,2)/2)/(2*sqrt(2*pi()))"), ("gauss", "n", "GAUSS", lambda: (F.lit(0.0),), "0"),
    ("logn", "n", "LOGNORM.INV", lambda: (call("LOGNORM.DIST", c("x"), 1, 2, True), 1, 2), "x"), ("logn2", "n", "LOGINV", lambda: (call("LOGNORMDIST", c("x"), 1, 2), 1, 2), "x"),
    ("t2", "n", "T.DIST", lambda: (c("x"), 2, True), "0.5+x/(2*sqrt(2+x*x))"), ("trt", "n", "T.DIST.RT", lambda: (c("x"), 2), "0.5-x/(2*sqrt(2+x*x))"), ("t2t", "n", "T.DIST.2T", lambda: (c("x"), 2), "1-x/sqrt(2+x*x)"), ("td", "n", "TDIST", lambda: (c("x"), 2, 2), "1-x/sqrt(2+x*x)"), ("ti", "n", "T.INV", lambda: (c("p"), 2), "(2*p-1)*sqrt(2/(4*p*(1-p)))"), ("ti2", "n", "T.INV.2T", lambda: (c("p"), 2), "(1-p)*sqrt(2/(p*(2-p)))"), ("ti3", "n", "TINV", lambda: (c("p"), 2), "(1-p)*sqrt(2/(p*(2-p)))"),
    ("chi", "n", "CHISQ.DIST", lambda: (c("x"), 2, True), "1-exp(-x/2)"), ("chirt", "n", "CHISQ.DIST.RT", lambda: (c("x"), 2), "exp(-x/2)"), ("chid", "n", "CHIDIST", lambda: (c("x"), 2), "exp(-x/2)"), ("chii", "n", "CHISQ.INV", lambda: (c("p"), 2), "-2*ln(1-p)"), ("chiir", "n", "CHISQ.INV.RT", lambda: (c("p"), 2), "-2*ln(p)"), ("chi2", "n", "CHIINV", lambda: (c("p"), 2), "-2*ln(p)"),
    ("fd", "n", "F.DIST", lambda: (c("x"), 2, 6, True), "1-pow(1+x/3,-3)"), ("frt", "n", "F.DIST.RT", lambda: (c("x"), 2, 6), "pow(1+x/3,-3)"), ("fdi", "n", "FDIST", lambda: (c("x"), 2, 6), "pow(1+x/3,-3)"), ("fi", "n", "F.INV", lambda: (c("p"), 2, 6), "3*(pow(1-p,-1/3.0)-1)"), ("firt", "n", "F.INV.RT", lambda: (c("p"), 2, 6), "3*(pow(p,-1/3.0)-1)"), ("fiv", "n", "FINV", lambda: (c("p"), 2, 6), "3*(pow(p,-1/3.0)-1)"),
    ("beta", "n", "BETA.DIST", lambda: (c("p"), 3, 1, True), "pow(p,3)"), ("betad", "n", "BETADIST", lambda: (c("p"), 3, 1), "pow(p,3)"), ("betai", "n", "BETA.INV", lambda: (c("p"), 3, 1), "pow(p,1/3.0)"), ("betaiv", "n", "BETAINV", lambda: (c("p"), 3, 1), "pow(p,1/3.0)"), ("gam", "n", "GAMMA.DIST", lambda: (c("x"), 1, 2, True), "1-exp(-x/2)"), ("gamd", "n", "GAMMADIST", lambda: (c("x"), 1, 2, True), "1-exp(-x/2)"), ("gami", "n", "GAMMA.INV", lambda: (c("p"), 1, 2), "-2*ln(1-p)"), ("gamiv", "n", "GAMMAINV", lambda: (c("p"), 1, 2), "-2*ln(1-p)"),
    ("bin", "n", "BINOM.DIST", lambda: (2, 10, c("p"), False), "45*p*p*pow(1-p,8)"), ("bind", "n", "BINOMDIST", lambda: (1, 10, c("p"), True), "pow(1-p,10)+10*p*pow(1-p,9)"), ("binr", "n", "BINOM.DIST.RANGE", lambda: (10, c("p"), 1, 2), "10*p*pow(1-p,9)+45*p*p*pow(1-p,8)"), ("bini", "n", "BINOM.INV", lambda: (1, c("p"), 0.5), "(1-p<0.5)::int"), ("crit", "n", "CRITBINOM", lambda: (1, c("p"), 0.5), "(1-p<0.5)::int"),
    ("poi", "n", "POISSON.DIST", lambda: (2, c("x"), False), "exp(-x)*x*x/2"), ("poid", "n", "POISSON", lambda: (1, c("x"), True), "exp(-x)*(1+x)"), ("neg", "n", "NEGBINOM.DIST", lambda: (2, 3, c("p"), False), "6*pow(p,3)*pow(1-p,2)"), ("negd", "n", "NEGBINOMDIST", lambda: (2, 3, c("p")), "6*pow(p,3)*pow(1-p,2)"), ("hyp", "n", "HYPGEOM.DIST", lambda: (F.lit(1), 4, 8, 20, False), "8*220/4845.0"), ("hypd", "n", "HYPGEOMDIST", lambda: (F.lit(1), 4, 8, 20), "8*220/4845.0"),
    ("exd", "n", "EXPON.DIST", lambda: (c("x"), 2, True), "1-exp(-2*x)"), ("exdd", "n", "EXPONDIST", lambda: (c("x"), 2, False), "2*exp(-2*x)"), ("wei", "n", "WEIBULL", lambda: (c("x"), 2, 3, True), "1-exp(-pow(x/3,2))"), ("weid", "n", "WEIBULL.DIST", lambda: (c("x"), 2, 3, True), "1-exp(-pow(x/3,2))"), ("conf", "n", "CONFIDENCE", lambda: (0.05, c("x"), 100), "x*1.959963984540054/10"), ("confn", "n", "CONFIDENCE.NORM", lambda: (0.05, c("x"), 100), "x*1.959963984540054/10"),
    ("conft", "n", "CONFIDENCE.T", lambda: (0.05, c("x"), 3), "x*4.302652729911275/sqrt(3)"), ("erfc", "n", "ERFC", lambda: (F.lit(0.0),), "1"), ("erf", "n", "ERF", lambda: (F.lit(0.0),), "0"),
], {"x": "p_size / 1e1", "p": "p_size / 5.2e1"})

_COMPLEX = {
    "IMEXP": ((), "exp(x)*cos(y)", "exp(x)*sin(y)"), "IMLN": ((), "ln(sqrt(x*x+y*y))", "atan2(y,x)"), "IMLOG10": ((), "ln(sqrt(x*x+y*y))/ln(10)", "atan2(y,x)/ln(10)"), "IMLOG2": ((), "ln(sqrt(x*x+y*y))/ln(2)", "atan2(y,x)/ln(2)"), "IMPOWER": ((2,), "x*x-y*y", "2*x*y"),
    "IMSIN": ((), "sin(x)*cosh(y)", "cos(x)*sinh(y)"), "IMCOS": ((), "cos(x)*cosh(y)", "-sin(x)*sinh(y)"), "IMSQRT": ((), "sqrt(sqrt(x*x+y*y))*cos(atan2(y,x)/2)", "sqrt(sqrt(x*x+y*y))*sin(atan2(y,x)/2)"), "IMCONJUGATE": ((), "x", "-y"),
    "IMSUM": (("1+2i",), "x+1", "y+2"), "IMSUB": (("1+2i",), "x-1", "y-2"), "IMPRODUCT": (("1+2i",), "x-2*y", "2*x+y"), "IMDIV": (("1+2i",), "(x+2*y)/5", "(y-2*x)/5"),
}


@register("fx_complex_more", f"SELECT n_nationkey, {', '.join(f'{_sql(re, _N)} AS {f.lower()}_re, {_sql(im, _N)} AS {f.lower()}_im' for f, (_, re, im) in _COMPLEX.items())}, {_sql('sqrt(x*x+y*y)', _N)} AS imabs, {_sql('atan2(y,x)', _N)} AS imargument FROM (SELECT n_nationkey, n_nationkey / 1e1 + 1 AS x, n_regionkey / 1e1 + 0.5 AS y FROM nation)")
def _complex(spark, sf):
    z = call("COMPLEX", F.round(c("n_nationkey") / 10 + 1, 1), F.round(c("n_regionkey") / 10 + 0.5, 1))
    d = table(spark, sf, "nation").select("n_nationkey", z.alias("z"))
    d = d.select("n_nationkey", "z", *[call(f, c("z"), *a).alias(f) for f, (a, _, _) in _COMPLEX.items()])
    parts = [_shown(call(g, c(f)), "n").alias(f"{f.lower()}_{p}") for f in _COMPLEX for g, p in (("IMREAL", "re"), ("IMAGINARY", "im"))]
    return d.select("n_nationkey", *parts, _shown(call("IMABS", c("z")), "n").alias("imabs"), _shown(call("IMARGUMENT", c("z")), "n").alias("imargument"))


def _v():
    return (c("o_totalprice"),)


def _vy():
    return c("o_totalprice"), c("o_custkey")


_SXX, _SXY, _SYY = "regr_sxx(o_totalprice,o_custkey)", "regr_sxy(o_totalprice,o_custkey)", "regr_syy(o_totalprice,o_custkey)"
_grouped("fx_aggregates_more", "orders", ["o_orderpriority"], lambda: [
    ("sum_", "SUM", lambda: (c("o_custkey"),), "sum(o_custkey)"), ("average_", "AVERAGE", _v, "avg(o_totalprice)"), ("min_", "MIN", _v, "min(o_totalprice)"), ("max_", "MAX", _v, "max(o_totalprice)"), ("averagea", "AVERAGEA", _v, "avg(o_totalprice)"), ("maxa", "MAXA", _v, "max(o_totalprice)"), ("mina", "MINA", _v, "min(o_totalprice)"), ("rows_", "ROWS", (), "count(*)"),
    ("percentile", "PERCENTILE", lambda: (c("o_totalprice"), 0.3), "quantile_cont(o_totalprice,0.3)"), ("quartileinc", "QUARTILE.INC", lambda: (c("o_totalprice"), 1), "quantile_cont(o_totalprice,0.25)"), 
    ("sumif", "SUMIF", lambda: (c("o_orderstatus"), "O", c("o_custkey")), "coalesce(sum(o_custkey) FILTER (o_orderstatus='O'),0)"), ("averageif", "AVERAGEIF", lambda: (c("o_orderstatus"), "O", c("o_custkey")), "avg(o_custkey) FILTER (o_orderstatus='O')"),
    ("pearson", "PEARSON", _vy, "corr(o_totalprice,o_custkey)"),
])
_S = "(l_quantity/10)"


def _q():
    return (c("l_quantity") / 10,)


def _qd():
    return c("l_quantity") / 10, c("l_discount")


_grouped("fx_spread", "lineitem", ["l_returnflag", "l_linestatus"], lambda: [
    ("stdev", "STDEV", _q, f"stddev_samp{_S}"), ("stdeva", "STDEVA", _q, f"stddev_samp{_S}"), ("stdevp", "STDEVP", _q, f"stddev_pop{_S}"), ("stdevpa", "STDEVPA", _q, f"stddev_pop{_S}"), ("var_", "VAR", _q, f"var_samp{_S}"), ("vara", "VARA", _q, f"var_samp{_S}"), ("varp", "VARP", _q, f"var_pop{_S}"), ("varpa", "VARPA", _q, f"var_pop{_S}"),
    ("covar", "COVAR", _qd, f"covar_pop({_S},l_discount)"), ("covarp", "COVARIANCE.P", _qd, f"covar_pop({_S},l_discount)"), ("covars", "COVARIANCE.S", _qd, f"covar_samp({_S},l_discount)"), ("skewp", "SKEW.P", _q, f"(avg(pow({_S},3))-3*avg{_S}*avg(pow({_S},2))+2*pow(avg{_S},3))/pow(var_pop{_S},1.5)"),
    ("steyx", "STEYX", _qd, f"sqrt((regr_syy({_S},l_discount)-pow(regr_sxy({_S},l_discount),2)/regr_sxx({_S},l_discount))/(count(*)-2))"), ("forecast", "FORECAST.LINEAR", lambda: (0.2, *_qd()), f"regr_intercept({_S},l_discount)+0.2*regr_slope({_S},l_discount)"),
    ("x2m", "SUMX2MY2", _qd, f"round(sum({_S}*{_S}-l_discount*l_discount),4)"), ("x2p", "SUMX2PY2", _qd, f"round(sum({_S}*{_S}+l_discount*l_discount),4)"),
])
_grouped("fx_groups_more", "orders", ["o_custkey"], lambda: [
    ("product", "PRODUCT", lambda: (c("o_totalprice") / 100000,), "product(o_totalprice/100000)"), ("quartileexc", "QUARTILE.EXC", lambda: (c("o_totalprice"), 2), "CASE WHEN count(*) >= 1 THEN median(o_totalprice) END"),
])

_DB = [("DAVERAGE", "avg(c_acctbal)"), ("DMAX", "max(c_acctbal)"), ("DMIN", "min(c_acctbal)"), ("DSTDEV", "stddev_samp(c_acctbal)"), ("DSTDEVP", "stddev_pop(c_acctbal)"), ("DVAR", "var_samp(c_acctbal)"), ("DVARP", "var_pop(c_acctbal)"), ("DCOUNT", "count(c_acctbal)"), ("DCOUNTA", "count(c_acctbal)")]


@register("fx_database_more", " UNION ALL ".join(f"SELECT '{n}' AS name, round(({s})::double, 4) AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0" for n, s in _DB))
def _database(spark, sf):
    d, out = table(spark, sf, "customer"), None
    for n, _ in _DB:
        one = call(n, d, "c_acctbal", [{"c_mktsegment": "=building", "c_acctbal": ">0"}]).select(F.lit(n).alias("name"), F.round(c("value").cast("double"), 4).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@register("fx_dproduct", "SELECT round(product(n_nationkey::double),4) AS value FROM nation WHERE n_regionkey = 2")
def _dproduct(spark, sf):
    return call("DPRODUCT", table(spark, sf, "nation"), "n_nationkey", [{"n_regionkey": "2"}]).select(F.round(c("value"), 4).alias("value"))


_wide("fx_arrays_more", "nation", ["n_nationkey"], lambda: [
    ("sort", "n", "INDEX", lambda: (call("SORT", c("a"), -1), 1), "n_nationkey+3"), ("sortby", "n", "INDEX", lambda: (call("SORTBY", c("a"), F.transform(c("a"), lambda v: -v)), 1), "n_nationkey+3"), ("take", "n", "INDEX", lambda: (call("TAKE", c("a"), -1), 1), "n_nationkey+3"), ("drop", "n", "INDEX", lambda: (call("DROP", c("a"), 1), 1), "n_nationkey+2"), ("uniq", "n", "INDEX", lambda: (call("UNIQUE", F.concat(c("a"), c("a"))), 3), "n_nationkey+3"),
    ("filt", "n", "INDEX", lambda: (call("FILTER", c("a"), F.transform(c("a"), lambda v: v > c("n_nationkey") + 2)), 1), "n_nationkey+3"), ("scan", "n", "INDEX", lambda: (call("SCAN", 0, c("a"), lambda s, v: s + v), 3), "3*n_nationkey+6"), ("byrow", "n", "INDEX", lambda: (call("BYROW", c("m"), lambda r: F.element_at(r, 1) + F.element_at(r, 2)), 2), "2*n_nationkey+3"), ("bycol", "n", "INDEX", lambda: (call("BYCOL", c("m"), lambda r: F.element_at(r, 1)), 2), "n_nationkey+2"),
    ("transpose", "n", "INDEX", lambda: (call("TRANSPOSE", c("m")), 1, 2), "n_nationkey+1"), ("make", "n", "INDEX", lambda: (call("MAKEARRAY", 2, 2, lambda i, j: i * 10 + j), 2, 1), "21"), ("tocol", "n", "INDEX", lambda: (call("TOCOL", c("m")), 3), "n_nationkey+1"), ("torow", "n", "INDEX", lambda: (call("TOROW", c("m")), 4), "n_nationkey+2"), ("vstack", "n", "INDEX", lambda: (call("VSTACK", c("m"), c("m")), 3, 1), "n_nationkey+1"), ("hstack", "n", "INDEX", lambda: (call("HSTACK", c("m"), c("m")), 1, 4), "n_nationkey+2"),
    ("wraprows", "n", "INDEX", lambda: (call("WRAPROWS", c("a"), 2), 2, 1), "n_nationkey+3"), ("wrapcols", "n", "INDEX", lambda: (call("WRAPCOLS", c("a"), 2), 1, 2), "n_nationkey+3"), ("expand", "n", "INDEX", lambda: (call("EXPAND", c("m"), 3, 3, 0.0), 3, 3), "0"), ("chooserows", "n", "INDEX", lambda: (call("CHOOSEROWS", c("m"), 2), 1, 1), "n_nationkey+1"), ("choosecols", "n", "INDEX", lambda: (call("CHOOSECOLS", c("m"), 2), 1, 1), "n_nationkey+2"),
    ("mdeterm", "n", "MDETERM", lambda: (F.array(F.array(c("n_nationkey") + 1.0, F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))),), "4*(n_nationkey+1)-6"), ("minverse", "n", "INDEX", lambda: (call("MINVERSE", F.array(F.array(c("n_nationkey") + 2.0, F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)))), 1, 1), "1.0/(n_nationkey+2)"), ("mmult", "n", "INDEX", lambda: (call("MMULT", c("m"), c("m")), 1, 1), "(n_nationkey+1)*(2*n_nationkey+3)"), ("munit", "n", "INDEX", lambda: (call("MUNIT", 3), 2, 2), "1"),
    ("linest", "n", "INDEX", lambda: (call("LINEST", F.transform(c("a"), lambda v: v * 3 + 1), c("a")), 1), "3"), ("trend", "n", "INDEX", lambda: (call("TREND", F.transform(c("a"), lambda v: v * 3 + 1), c("a"), F.array(F.lit(100.0))), 1), "301"), ("logest", "n", "INDEX", lambda: (call("LOGEST", F.transform(c("a"), lambda v: F.exp(v / 10)), c("a")), 1), "exp(0.1)"), ("growth", "n", "INDEX", lambda: (call("GROWTH", F.transform(c("a"), lambda v: F.exp(v / 10)), c("a"), F.array(F.lit(10.0))), 1), "exp(1)"),
    ("let", "n", "LET", lambda: (c("n_nationkey"), lambda v: v * 2), "n_nationkey*2"), ("reduce", "n", "REDUCE", lambda: (0, c("a"), lambda s, v: s + v), "3*n_nationkey+6"), ("map", "n", "INDEX", lambda: (call("MAP", c("a"), lambda v: v * 2), 1), "2*n_nationkey+2"),
], arrays={"a": "array(n_nationkey + 1.0D, n_nationkey + 2.0D, n_nationkey + 3.0D)", "m": "array(array(n_nationkey + 1.0D, n_nationkey + 2.0D), array(n_nationkey + 1.0D, n_nationkey + 2.0D))"})


@register("fx_avedev", "SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS a FROM (SELECT l_returnflag, l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1")
def _avedev(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(call("AVEDEV", c("l_quantity")), 6).alias("a"))


@register("fx_prob", "SELECT sum(p) AS p FROM (SELECT n_nationkey, 1.0/25 AS p FROM nation) WHERE n_nationkey BETWEEN 3 AND 7")
def _prob(spark, sf):
    return table(spark, sf, "nation").agg(F.round(call("PROB", c("n_nationkey"), F.lit(1) / 25, 3, 7), 9).alias("p"))


@register("fx_modes", "SELECT l_linenumber, l_quantity AS mode FROM (SELECT l_linenumber, l_quantity, rank() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) WHERE r = 1")
def _modes(spark, sf):
    return call("MODE.MULT", table(spark, sf, "lineitem"), "l_quantity", ["l_linenumber"])


@register("fx_mode_sngl", "SELECT l_linenumber, min(l_quantity) AS mode FROM (SELECT l_linenumber, l_quantity, rank() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) WHERE r = 1 GROUP BY 1")
def _mode_sngl(spark, sf):
    return call("MODE.SNGL", table(spark, sf, "lineitem"), "l_quantity", None, ["l_linenumber"])


@register("fx_rank", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) AS r FROM supplier")
def _ranked(spark, sf):
    return call("RANK", table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "r", 1).select("s_suppkey", "r")


@register("fx_xmatch", "SELECT c_custkey, r AS position FROM customer LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS r FROM nation) ON n_nationkey = c_nationkey")
def _xmatch(spark, sf):
    return call("XMATCH", table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation").orderBy("n_name"), "n_nationkey").drop("c_nationkey")


@register("fx_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _lookup(spark, sf):
    return call("LOOKUP", table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name").drop("c_nationkey")


@register("fx_hlookup", "SELECT 'r_name' AS k, r_name AS v FROM region WHERE r_regionkey = 2")
def _hlookup(spark, sf):
    return call("HLOOKUP", spark.createDataFrame([("r_name",)], "k string"), "k", table(spark, sf, "region").orderBy("r_regionkey"), 3)


@register("fx_row", "SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS row FROM nation")
def _row(spark, sf):
    return call("ROW", table(spark, sf, "nation").select("n_name").orderBy(F.desc("n_name")))


@register("fx_offset", "SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) WHERE r BETWEEN 4 AND 8")
def _offset(spark, sf):
    return call("OFFSET", table(spark, sf, "nation").orderBy("n_nationkey"), 3, 1, 5, 1)


@register("fx_shape", "SELECT 3::bigint AS columns, 2::bigint AS at, 2::bigint AS areas, 1::bigint AS sheet, 1::bigint AS sheets, false AS isref, false AS isformula, '#N/A' AS text")
def _shape(spark, sf):
    d = table(spark, sf, "nation")
    n = lambda x: (x if not isinstance(x, int) else F.lit(x)).cast("long")
    return spark.range(1).select(n(call("COLUMNS", d)).alias("columns"), n(call("COLUMN", d, "n_name")).alias("at"), n(call("AREAS", 1, 2)).alias("areas"), n(call("SHEET")).alias("sheet"), n(call("SHEETS")).alias("sheets"), call("ISREF", 1).alias("isref"), call("ISFORMULA", 1).alias("isformula"), call("FORMULATEXT", 1).alias("text"))


@register("fx_random", "SELECT count(*) AS n, true AS rand, true AS between_, true AS array_, true AS today, true AS now FROM customer")
def _random(spark, sf):
    d = table(spark, sf, "customer")
    r = d.select(call("RAND").alias("a"), call("RANDBETWEEN", 3, 7).alias("b"), call("INDEX", call("RANDARRAY", 2, 2, 5, 6), 2, 2).alias("c"), call("TODAY").alias("t"), call("NOW").alias("w"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and((c("a") >= 0) & (c("a") < 1)).alias("rand"), F.bool_and(c("b").isin(3, 4, 5, 6, 7)).alias("between_"), F.bool_and((c("c") >= 5) & (c("c") < 6)).alias("array_"), F.bool_and(c("t") == F.current_date()).alias("today"), F.bool_and(c("w") == F.current_timestamp()).alias("now"))


@register("fx_tests", "SELECT 1.0::double AS t, 1.0::double AS f, 1.0::double AS chi, 0.5::double AS z")
def _tests(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", c("l_quantity").alias("again"))
    mean = d.agg(F.avg("l_quantity")).first()[0]
    one = [call("T.TEST", d, "l_quantity", "again", 2, 2).select(F.round("p", 6).alias("t")), call("F.TEST", d, "l_quantity", "again").select(F.round("p", 6).alias("f")), call("CHISQ.TEST", d, "l_quantity", "again").select(F.round("p", 6).alias("chi")), call("Z.TEST", d, "l_quantity", mean).select(F.round("p", 6).alias("z"))]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # one row each
    return out


@register("fx_cube", "SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS value, (SELECT count(*) FROM region) AS members, 'AFRICA' AS first, 'ASIA' AS member, 2::bigint AS property")
def _cube(spark, sf):
    from gridloom.plans.dax_queries import star

    m = star(spark, sf)
    value = call("CUBEVALUE", m, "[Orders]", 'region[r_name] = "ASIA"')
    members = call("CUBESET", m, "region", "r_name")
    first, member = call("CUBERANKEDMEMBER", members, 1), call("CUBEMEMBER", m, "region", "r_name", "ASIA")
    prop = call("CUBEMEMBERPROPERTY", m, "region", "r_name", "ASIA", "r_regionkey")
    parts = [value.toDF("value"), first.toDF("first"), member.toDF("member"), prop.toDF("property")]
    out = parts[0].withColumn("members", F.lit(call("CUBESETCOUNT", members)).cast("long"))
    for x in parts[1:]:
        out = out.crossJoin(x)  # one row each
    return out.withColumn("property", c("property").cast("long"))
