"""Predicates on one node, each a boolean Column that is never null: filters inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.terms import BNODE, IRI, LANGSTRING, LITERAL, XSD, Node, same

KINDS = {
    "IRI": (IRI,), "BlankNode": (BNODE,), "Literal": (LITERAL,), "BlankNodeOrIRI": (BNODE, IRI), "BlankNodeOrLiteral": (BNODE, LITERAL), "IRIOrLiteral": (IRI, LITERAL),
    "iri": (IRI,), "bnode": (BNODE,), "literal": (LITERAL,), "nonliteral": (IRI, BNODE),
}
# fixed values: ranges of the derived integer types
RANGES = {
    "byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1),
    "unsignedByte": (0, 2**8 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedLong": (0, 2**64 - 1),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "integer": (None, None),
}
_ZONE = r"(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)"
_DAY, _TIME = r"-?([1-9]\d{3,}|0\d{3})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", r"(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?)"
# fixed values: lexical forms of XML Schema's types
LEXICAL = {
    "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "float": r"([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)", "boolean": r"(true|false|1|0)",
    "date": f"{_DAY}{_ZONE}?", "dateTime": f"{_DAY}T{_TIME}{_ZONE}?", "dateTimeStamp": f"{_DAY}T{_TIME}{_ZONE}", "time": f"{_TIME}{_ZONE}?",
    "gYear": rf"-?([1-9]\d{{3,}}|0\d{{3}}){_ZONE}?", "gYearMonth": rf"-?([1-9]\d{{3,}}|0\d{{3}})-(0[1-9]|1[0-2]){_ZONE}?", "gMonth": rf"--(0[1-9]|1[0-2]){_ZONE}?",
    "gDay": rf"---(0[1-9]|[12]\d|3[01]){_ZONE}?", "gMonthDay": rf"--(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]){_ZONE}?",
    "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?", "hexBinary": r"([0-9A-Fa-f]{2})*",
    "base64Binary": r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?",
    "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
}
LEXICAL["double"] = LEXICAL["float"]
NUMERIC = [XSD + t for t in (*RANGES, "decimal", "float", "double")]
EXACT = [XSD + t for t in (*RANGES, "decimal")]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def kind_in(v: Column, name: str) -> Column:
    return v["kind"].isin(*KINDS[name])


def well_formed(v: Column, dt: str) -> Column:
    """Whether the lexical form belongs to a known datatype; unknown ones take any."""
    t = dt.removeprefix(XSD)
    if t == dt:
        return F.lit(True)
    if t in RANGES:
        low, high = RANGES[t]
        ok = v["lex"].rlike(r"^[+-]?\d+$")
        if low is not None or high is not None:
            n, sign = F.expr("null"), None
            bare = F.regexp_replace(v["lex"], r"^[+-]?0*(?=\d)", "")
            n = F.when(F.length(bare) <= 30, F.concat(F.when(v["lex"].startswith("-"), "-").otherwise(""), bare).try_cast("decimal(38,0)"))
            sign = v["lex"].startswith("-") & (bare != "0")
            in_range = F.lit(True)
            if low is not None:
                in_range &= F.when(n.isNull(), ~sign).otherwise(n >= F.lit(str(low)).cast("decimal(38,0)"))
            if high is not None:
                in_range &= F.when(n.isNull(), sign).otherwise(n <= F.lit(str(high)).cast("decimal(38,0)"))
            ok &= in_range
        return _true(ok)
    if t in LEXICAL:
        return v["lex"].rlike(f"^(?:{LEXICAL[t]})$")
    return F.lit(True)


def datatype(v: Column, dt: str, lexical: bool = True) -> Column:
    ok = (v["kind"] == LITERAL) & (v["dt"] == dt)
    return ok & well_formed(v, dt) if lexical else ok


def number(v: Column) -> tuple[Column, Column]:
    """(exact, approximate) value of a numeric literal, null otherwise; exact is null for floating types."""
    ok = (v["kind"] == LITERAL) & v["dt"].isin(*NUMERIC) & v["lex"].rlike(f"^{LEXICAL['float']}$")
    lex = F.regexp_replace(v["lex"], "INF$", "Infinity")
    return F.when(ok & v["dt"].isin(*EXACT), v["lex"].try_cast("decimal(38,18)")), F.when(ok, lex.try_cast("double"))


_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


_ORDERED = (("dateTime", ("dateTime", "dateTimeStamp")), ("date", ("date",)))


def ordered(v: Column) -> Column:
    """What a literal's order depends on, parsed once: its value space (0: none) and its value there.

    Spaces are numbers (1), instants and days with and without a time zone (2 to 5), strings (6), booleans (7).
    """
    exact, approximate = number(v)
    space = F.when(approximate.isNotNull() & ~F.isnan(approximate), 1)
    instant = F.lit(None).cast("timestamp")
    for i, (t, kinds) in enumerate(_ORDERED):
        is_one = v["dt"].isin(*(XSD + k for k in kinds)) & v["lex"].rlike(f"^{LEXICAL[t]}$")
        zoned = v["lex"].rlike(f"{_ZONE}$")
        stamp = F.concat(F.regexp_replace(v["lex"], f"{_ZONE}$", ""), F.lit("T00:00:00"), F.regexp_extract(v["lex"], f"{_ZONE}$", 1)) if t == "date" else v["lex"]
        utc = F.when(zoned, stamp).otherwise(F.concat(stamp, F.lit("Z"))).try_cast("timestamp")
        space = space.when(is_one & utc.isNotNull(), F.lit(2 + 2 * i) + zoned.cast("int"))
        instant = F.when(is_one, utc).otherwise(instant)
    space = space.when(v["dt"] == XSD + "string", 6).when((v["dt"] == XSD + "boolean") & v["lex"].isin("true", "1", "false", "0"), 7)
    space = F.when(v["kind"] == LITERAL, F.coalesce(space, F.lit(0))).otherwise(0)
    return F.struct(space.alias("space"), exact.alias("exact"), approximate.alias("approximate"), instant.alias("instant"), F.when(space == 6, v["lex"]).alias("text"), v["lex"].isin("true", "1").cast("int").alias("truth"))


def in_order(a: Column, b: Column, op: str) -> Column:
    """a op b for what `ordered` makes of two terms; false where they can't be compared."""
    f = _OPS[op]
    numbers = F.when(a["exact"].isNotNull() & b["exact"].isNotNull(), f(a["exact"], b["exact"])).otherwise(f(a["approximate"], b["approximate"]))
    space = a["space"]
    held = F.when(space == 1, numbers).when(space.between(2, 5), f(a["instant"], b["instant"])).when(space == 6, f(a["text"], b["text"])).when(space == 7, f(a["truth"], b["truth"]))
    return _true(F.when(space == b["space"], held))


def compare(a: Column, b: Column, op: str) -> Column:
    """a op b for literals of one value space; false if they can't be compared.

    Numbers compare across numeric types, exactly where both are exact; dateTime and date only if both
    or neither have a time zone; strings by code point; booleans false before true.
    """
    return in_order(ordered(a), ordered(b), op)


def length(v: Column, op: str, n: int, bnodes: bool = False) -> Column:
    """Code points of the lexical form or IRI against n; blank nodes fail unless `bnodes`."""
    size = F.char_length(v["lex"])
    test = {"=": size == n, "<=": size <= n, ">=": size >= n}[op]
    return test if bnodes else (v["kind"] != BNODE) & test


def java_regex(pattern: str, flags: str = "") -> str:
    """An XPath pattern and flags as a Java pattern."""
    if "q" in flags:
        pattern = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    inline = "".join(f for f in flags if f in "smix")
    return (f"(?{inline})" if inline else "") + pattern


def pattern(v: Column, regex: str, flags: str = "", bnodes: bool = False) -> Column:
    found = v["lex"].rlike(java_regex(regex, flags))
    return found if bnodes else (v["kind"] != BNODE) & found


def language_matches(lang: Column, tag: str) -> Column:
    t = tag.lower()
    return lang != "" if t in ("*", "") else (lang == t) | lang.startswith(t + "-")


def language_in(v: Column, tags: list[str]) -> Column:
    out = F.lit(False)
    for t in tags:
        out |= language_matches(v["lang"], t)
    return (v["kind"] == LITERAL) & out


def in_list(v: Column, nodes: list[Node]) -> Column:
    if not nodes:
        return F.lit(False)
    if len(nodes) > 8:
        key = F.concat_ws("\u0001", v["kind"].cast("string"), v["lex"], v["dt"], v["lang"])
        return key.isin(*("\u0001".join((str(n.kind), n.lex, n.dt, n.lang)) for n in nodes))
    out = F.lit(False)
    for n in nodes:
        out |= same(v, n)
    return out


def digits(v: Column, n: int, fraction: bool) -> Column:
    """totaldigits or fractiondigits at most n of a decimal's canonical form."""
    ok = (v["kind"] == LITERAL) & v["dt"].isin(*EXACT) & v["lex"].rlike(f"^{LEXICAL['decimal']}$")
    whole = F.regexp_replace(F.regexp_extract(v["lex"], r"^[+-]?(\d*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(v["lex"], r"\.(\d*)$", 1), "0+$", "")
    return ok & ((F.length(part) if fraction else F.length(whole) + F.length(part)) <= n)


def lang_literal(v: Column) -> Column:
    return (v["kind"] == LITERAL) & (v["dt"] == LANGSTRING)
