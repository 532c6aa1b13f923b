"""XSD datatypes and facets as Column expressions, and interval arithmetic on data ranges.

Literals stay (lexical, datatype); these expressions read them on demand, inside code generation.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the integer datatypes.
INTEGERS = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}
#: datatype -> the one it is derived from
PARENT = {
    "integer": "decimal", "long": "integer", "int": "long", "short": "int", "byte": "short", "nonNegativeInteger": "integer", "positiveInteger": "nonNegativeInteger",
    "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger", "unsignedLong": "nonNegativeInteger", "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt",
    "unsignedByte": "unsignedShort", "decimal": "rational", "rational": "real", "normalizedString": "string", "token": "normalizedString", "language": "token", "Name": "token", "NCName": "Name", "NMTOKEN": "token", "dateTimeStamp": "dateTime",
}
STRINGS = ("string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN", "PlainLiteral", "langString", "anyURI")
# Lexical forms.
DECIMAL, INTEGER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", r"^[+-]?[0-9]+$"
FLOAT = r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
DATETIME = r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])?$"


def subsumed(sub: str, sup: str) -> bool:
    """Whether every value of one built-in datatype is one of another."""
    while sub != sup:
        if sub not in PARENT:
            return False
        sub = PARENT[sub]
    return True


def number(lexical: Column) -> Column:
    """The value of a decimal literal, null if it is none (or has over 38 digits)."""
    return F.when(lexical.rlike(DECIMAL), lexical.try_cast("decimal(38,10)"))


def in_value_space(lexical: Column, datatype: str) -> Column:
    """Whether a lexical form denotes a value of the datatype; null stays null."""
    if datatype in INTEGERS:
        low, high = INTEGERS[datatype]
        value = lexical.try_cast("decimal(38,0)")
        ok = lexical.rlike(INTEGER)
        if low is not None:
            ok = ok & F.coalesce(value >= F.lit(str(low)).cast("decimal(38,0)"), F.lit(False))
        if high is not None:
            ok = ok & F.coalesce(value <= F.lit(str(high)).cast("decimal(38,0)"), F.lit(False))
        return ok
    if datatype == "decimal":
        return lexical.rlike(DECIMAL)
    if datatype in ("float", "double"):
        return lexical.rlike(FLOAT)
    if datatype == "rational":
        return lexical.rlike(r"^[+-]?[0-9]+/[0-9]*[1-9][0-9]*$") | lexical.rlike(DECIMAL)
    if datatype == "boolean":
        return lexical.isin("true", "false", "0", "1")
    if datatype in ("dateTime", "dateTimeStamp"):
        ok = lexical.rlike(DATETIME) & lexical.substr(1, 19).try_cast("timestamp_ntz").isNotNull()
        return ok & lexical.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") if datatype == "dateTimeStamp" else ok
    if datatype == "hexBinary":
        return lexical.rlike("^([0-9a-fA-F]{2})*$")
    if datatype == "base64Binary":
        return lexical.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.lit(True) if datatype in STRINGS or datatype in ("real", "XMLLiteral") else F.lit(False)


def length_of(lexical: Column, datatype: str) -> Column:
    if datatype == "hexBinary":
        return (F.length(lexical) / 2).cast("int")
    if datatype == "base64Binary":
        return F.octet_length(F.unbase64(lexical))
    return F.char_length(lexical)


def equal(a: Column, a_type: Column, b: Column, b_type: Column) -> Column:
    """Value equality: numbers across datatypes, booleans by value, all else by lexical form and datatype."""
    numeric = [*INTEGERS, "decimal", "rational"]
    both = a_type.isin(numeric) & b_type.isin(numeric)
    floats = a_type.isin("float", "double") & (a_type == b_type)
    truth = lambda x: x.isin("true", "1")
    return (
        F.when(both, F.coalesce(number(a) == number(b), F.lit(False)))
        .when(floats, F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False)))
        .when((a_type == "boolean") & (b_type == "boolean"), truth(a) == truth(b))
        .otherwise((a == b) & (a_type == b_type))
    )


def canonical(lexical: Column, datatype: Column) -> Column:
    """One string for each value, so that equal literals compare equal as strings.  Numbers and instants are told by value,
    all else by lexical form and datatype; numbers beyond 38 digits by lexical form."""
    kind = F.regexp_replace(datatype, "^xsd:", "")
    num = number(lexical)
    zoned = lexical.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")
    return (
        F.when(kind.isin(*INTEGERS, "decimal") & num.isNotNull(), F.concat(F.lit("number "), num.cast("string")))
        .when(kind.isin("float", "double"), F.concat(kind, F.lit(" "), F.coalesce(lexical.try_cast("double").cast("string"), lexical)))
        .when(kind == "boolean", F.concat(F.lit("boolean "), F.when(lexical.isin("true", "1"), "true").otherwise("false")))
        .when(kind.startswith("dateTime") & zoned, F.concat(F.lit("instant "), F.coalesce(F.unix_micros(lexical.try_cast("timestamp")).cast("string"), lexical)))
        .when(kind.isin("string", "PlainLiteral") | (datatype == "rdf:PlainLiteral"), F.concat(F.lit("string "), lexical))
        .otherwise(F.concat(kind, F.lit(" "), lexical))
    )


#: Datatypes whose value spaces in_value_space knows.
KNOWN = (*INTEGERS, "decimal", "float", "double", "boolean", "dateTime", "dateTimeStamp", "hexBinary", "base64Binary", *STRINGS)


def in_space_of(lexical: Column, kind: Column) -> Column:
    """in_value_space for a datatype that is a column (without xsd:); null for datatypes that are not known.  Bounds are looked up, so
    the expression stays small."""
    value = lexical.try_cast("decimal(38,0)")

    def bound(i):
        known = [(k, v[i]) for k, v in INTEGERS.items() if v[i] is not None]
        return F.try_element_at(F.create_map(*[F.lit(x) for k, v in known for x in (k, str(v))]), kind).cast("decimal(38,0)")

    low, high = bound(0), bound(1)
    whole = lexical.rlike(INTEGER) & F.coalesce(value >= low, low.isNull()) & F.coalesce(value <= high, high.isNull())
    out = F.when(kind.isin(*INTEGERS), whole)
    for name in ("decimal", "double", "boolean", "dateTime", "dateTimeStamp", "hexBinary", "base64Binary"):
        out = out.when(kind.isin("float", "double") if name == "double" else kind == name, in_value_space(lexical, name))
    return out.when(kind.isin(*STRINGS), F.lit(True))


def ill_typed(lexical: Column, datatype: Column) -> Column:
    """Whether a literal's lexical form denotes no value of its own datatype; unknown datatypes take any."""
    return F.coalesce(~in_space_of(lexical, F.regexp_replace(datatype, "^xsd:", "")), F.lit(False))


def value_in(lexical: Column, datatype: Column, wanted: Column) -> Column:
    """Whether a literal's value is one of the datatype ``wanted``.  Numbers, floats, strings and the rest have disjoint value spaces;
    an unknown datatype may be anything."""
    own, want = F.regexp_replace(datatype, "^(xsd|rdf):", ""), F.regexp_replace(wanted, "^(xsd|rdf):", "")
    family = lambda k: F.when(k.isin(*INTEGERS, "decimal"), "number").when(k.isin(*STRINGS), "string").when(k.startswith("dateTime"), "instant").otherwise(k)
    plain = F.when(want.isin(*INTEGERS), F.regexp_replace(lexical, r"\.0*$", "")).otherwise(lexical)
    known = own.isin(*KNOWN) & want.isin(*KNOWN)
    return F.when(known, (family(own) == family(want)) & F.coalesce(in_space_of(plain, want), F.lit(True))).otherwise(True)


@dataclass(frozen=True)
class Range:
    """A data range: a datatype cut down by facets, or a combination of ranges.

    kind: datatype, and, or, not, one_of."""

    kind: str = "datatype"
    datatype: str = "string"
    facets: tuple[tuple[str, str], ...] = ()
    parts: tuple["Range", ...] = ()
    values: tuple[str, ...] = ()

    def __and__(self, other):
        return Range("and", parts=(self, other))

    def __or__(self, other):
        return Range("or", parts=(self, other))

    def __invert__(self):
        return Range("not", parts=(self,))


def matches(lexical: Column, r: Range) -> Column:
    """Membership of a literal in a data range, as a predicate that filters can push down."""
    if r.kind == "one_of":
        return lexical.isin(*r.values) if r.values else F.lit(False)
    if r.kind == "not":
        return ~matches(lexical, r.parts[0])
    if r.kind in ("and", "or"):
        out = matches(lexical, r.parts[0])
        for p in r.parts[1:]:
            out = out & matches(lexical, p) if r.kind == "and" else out | matches(lexical, p)
        return out
    out = in_value_space(lexical, r.datatype)
    if r.datatype in ("float", "double"):
        value, bound = lexical.try_cast("double"), lambda x: F.lit(float(x))
    elif r.datatype.startswith("dateTime"):
        value, bound = lexical.try_cast("timestamp"), lambda x: F.lit(x).try_cast("timestamp")
    else:
        value, bound = number(lexical), lambda x: F.lit(x).cast("decimal(38,10)")
    for facet, x in r.facets:
        test = {
            "minInclusive": lambda: value >= bound(x), "maxInclusive": lambda: value <= bound(x), "minExclusive": lambda: value > bound(x), "maxExclusive": lambda: value < bound(x),
            "length": lambda: length_of(lexical, r.datatype) == int(x), "minLength": lambda: length_of(lexical, r.datatype) >= int(x), "maxLength": lambda: length_of(lexical, r.datatype) <= int(x),
            "pattern": lambda: lexical.rlike(f"^(?:{x})$"),
        }[facet]()
        out = out & F.coalesce(test, F.lit(False))
    return out


@dataclass(frozen=True)
class Interval:
    """Numbers between bounds; ``integral`` ones only if asked."""

    low: Fraction | None = None
    high: Fraction | None = None
    low_open: bool = False
    high_open: bool = False
    integral: bool = False
    excluded: frozenset = field(default_factory=frozenset)

    def meet(self, other: Interval) -> Interval:
        low, low_open = max(((b, o) for b, o in ((self.low, self.low_open), (other.low, other.low_open)) if b is not None), default=(None, False))
        highs = [(b, not o) for b, o in ((self.high, self.high_open), (other.high, other.high_open)) if b is not None]
        high, closed = min(highs, default=(None, True))
        return Interval(low, high, low_open, not closed, self.integral or other.integral, self.excluded | other.excluded)

    def count(self) -> float:
        """How many values: exact for integers, 0, 1 or infinity else."""
        if not self.integral:
            if self.low is None or self.high is None or self.low < self.high:
                return math.inf
            return float(self.low == self.high and not self.low_open and not self.high_open and self.low not in self.excluded)
        if self.low is None or self.high is None:
            return math.inf
        low = math.floor(self.low) + 1 if self.low_open else math.ceil(self.low)
        high = math.ceil(self.high) - 1 if self.high_open else math.floor(self.high)
        return max(0, high - low + 1) - sum(low <= x <= high and x.denominator == 1 for x in self.excluded)


def interval(r: Range) -> Interval:
    """A numeric range without ``or`` as one interval."""
    if r.kind == "and":
        out = Interval()
        for p in r.parts:
            out = out.meet(interval(p))
        return out
    if r.kind == "not" and r.parts[0].kind == "one_of":
        return Interval(excluded=frozenset(Fraction(v) for v in r.parts[0].values))
    low, high = INTEGERS.get(r.datatype, (None, None))
    out = Interval(None if low is None else Fraction(low), None if high is None else Fraction(high), integral=r.datatype in INTEGERS)
    for facet, x in r.facets:
        x = Fraction(x)
        cut = {"minInclusive": Interval(low=x), "minExclusive": Interval(low=x, low_open=True), "maxInclusive": Interval(high=x), "maxExclusive": Interval(high=x, high_open=True)}[facet]
        out = out.meet(cut)
    return out


def satisfiable(r: Range, at_least: int = 1) -> bool:
    """Whether a numeric range has that many values."""
    if r.kind == "or":
        return any(satisfiable(p, at_least) for p in r.parts) or sum(interval(p).count() for p in r.parts if p.kind != "or") >= at_least
    if r.kind == "one_of":
        return len(set(r.values)) >= at_least
    return interval(r).count() >= at_least
