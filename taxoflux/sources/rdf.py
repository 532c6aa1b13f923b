"""N-Triples (distributed), a Turtle subset and RDF/XML, as triples; format detection; local imports."""
from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflux.ontology import OntologyError
from taxoflux.sources.functional import PREFIXES

c = F.col
MAX_BYTES = 256 << 20
LINE = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>|_:[^\s\"]+)|\"((?:[^\"\\]|\\.)*)\"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$"


def short(column):
    """Well-known namespaces as prefixes; full IRIs without brackets."""
    x = F.regexp_replace(column, "^<(.*)>$", "$1")
    for prefix, base in PREFIXES.items():
        x = F.when(x.startswith(base), F.concat(F.lit(prefix + ":"), F.substring(x, len(base) + 1, 8192))).otherwise(x)
    return x


BLANK = r"^\s*(#.*)?$"


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines that are no triples, comments or blank."""
    return spark.read.text(path).where(~c("value").rlike(LINE) & ~c("value").rlike(BLANK))


def read_ntriples(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(s, p, o, o_is_literal, datatype): one row a line, split and parsed by Spark alone.  A malformed line is an
    error when it is read; lenient reading leaves it out (see malformed)."""
    lines = spark.read.text(path).where(~c("value").rlike(BLANK))
    if lenient:
        lines = lines.where(c("value").rlike(LINE))
    else:
        lines = lines.where(F.when(c("value").rlike(LINE), True).otherwise(F.raise_error(F.concat(F.lit("no triple: "), "value")).cast("boolean")))
    part = lambda i: F.regexp_extract("value", LINE, i)
    literal = part(3) == ""
    kind = F.when(part(6) != "", F.lit("rdf:langString")).when(part(5) != "", short(part(5))).otherwise("xsd:string")
    return lines.select(short(part(1)).alias("s"), short(part(2)).alias("p"), F.when(literal, part(4)).otherwise(short(part(3))).alias("o"), literal.alias("o_is_literal"), F.when(literal, kind).alias("datatype"))


def detect(text: str, path: str = "") -> str:
    """functional, turtle, ntriples, rdfxml or owlxml: by what a document starts with, then by its name."""
    head = text.lstrip("﻿ \t\r\n")[:4096]
    if head.startswith("<?xml") or head.startswith("<!DOCTYPE") or re.match(r"<(rdf:RDF|Ontology)\b", head):
        return "owlxml" if re.search(r"<Ontology\b", head) else "rdfxml"
    if re.match(r"(Prefix|Ontology)\s*\(", head):
        return "functional"
    if re.match(r"@prefix|@base|PREFIX\b", head):
        return "turtle"
    if re.match(r"(<[^>]*>|_:\S+)\s+<[^>]*>\s+", head):
        return "ntriples"
    return {".ofn": "functional", ".ttl": "turtle", ".nt": "ntriples", ".rdf": "rdfxml", ".owl": "rdfxml", ".owx": "owlxml"}.get(os.path.splitext(path)[1], "functional")


TURTLE = re.compile(r'\s+|#[^\n]*|(?P<lit>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")|(?P<iri><[^<>\s]*>)|(?P<mark>\^\^|@[A-Za-z0-9-]+|[.;,\[\]()])|(?P<word>[^\s<>"\[\](),;^]+)')


def parse_turtle(text: str) -> list[tuple]:
    """Triples of a Turtle text: prefixes, predicate and object lists, blank nodes, collections, typed literals."""
    tokens = []
    at = 0
    while at < len(text):
        m = TURTLE.match(text, at)
        if not m:
            raise OntologyError(f"cannot read {text[at : at + 30]!r}")
        if m.lastgroup:
            word = m[m.lastgroup]
            if m.lastgroup == "word" and word.endswith(".") and len(word) > 1:
                tokens += [("word", word[:-1]), ("mark", ".")]
            else:
                tokens.append((m.lastgroup, word))
        at = m.end()
    prefixes, base, out, fresh = {}, "", [], [0]
    i = 0

    def name(kind, word):
        if kind == "iri":
            iri = word[1:-1]
            iri = iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base + iri
        elif word == "a":
            return "rdf:type"
        elif word.startswith("_:"):
            return word
        else:
            prefix, colon, local = word.partition(":")
            if not colon or prefix not in prefixes:
                raise OntologyError(f"unknown prefix in {word!r}")
            iri = prefixes[prefix] + local
        return next((f"{p}:{iri[len(b) :]}" for p, b in PREFIXES.items() if iri.startswith(b)), iri)

    def node():
        nonlocal i
        kind, word = tokens[i]
        i += 1
        if word == "[" and kind == "mark":
            fresh[0] += 1
            blank = f"_:b{fresh[0]}"
            if tokens[i][1] != "]":
                predicates(blank)
            i += 1
            return blank, False, None
        if word == "(" and kind == "mark":
            items = []
            while tokens[i][1] != ")":
                items.append(node())
            i += 1
            last = "rdf:nil"
            for value, literal, datatype in reversed(items):
                fresh[0] += 1
                cell = f"_:b{fresh[0]}"
                out.append((cell, "rdf:first", value, literal, datatype))
                out.append((cell, "rdf:rest", last, False, None))
                last = cell
            return last, False, None
        if kind == "lit":
            value = word[3:-3] if word.startswith('"""') else word[1:-1]
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value)
            if i < len(tokens) and tokens[i][1] == "^^":
                i += 2
                return value, True, name(*tokens[i - 1])
            if i < len(tokens) and tokens[i][1].startswith("@"):
                i += 1
                return value, True, "rdf:langString"
            return value, True, "xsd:string"
        if re.fullmatch(r"[+-]?[0-9]+", word):
            return word, True, "xsd:integer"
        if re.fullmatch(r"[+-]?[0-9]*\.[0-9]+", word):
            return word, True, "xsd:decimal"
        if word in ("true", "false"):
            return word, True, "xsd:boolean"
        return name(kind, word), False, None

    def predicates(subject):
        nonlocal i
        while True:
            p = name(*tokens[i])
            i += 1
            while True:
                value, literal, datatype = node()
                out.append((subject, p, value, literal, datatype))
                if tokens[i][1] != ",":
                    break
                i += 1
            while i < len(tokens) and tokens[i][1] == ";":
                i += 1
                if tokens[i][1] in (".", "]", ";"):
                    continue
            if tokens[i][1] in (".", "]"):
                return
            if tokens[i - 1][1] != ";":
                raise OntologyError(f"expected ; or . before {tokens[i][1]!r}")

    while i < len(tokens):
        word = tokens[i][1].lower()
        if word in ("@prefix", "prefix"):
            prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1][1:-1]
            i += 3 + (word[0] == "@")
        elif word in ("@base", "base"):
            base = tokens[i + 1][1][1:-1]
            i += 2 + (word[0] == "@")
        else:
            subject, _, _ = node()
            if tokens[i][1] != ".":
                predicates(subject)
            i += 1
    return out


def parse_ntriples(text: str) -> tuple[list[tuple], list[str]]:
    """(triples, malformed lines) of a text."""
    out, bad = [], []
    name = lambda x: next((f"{p}:{x[len(b) :]}" for p, b in PREFIXES.items() if x.startswith(b)), x)
    for line in text.splitlines():
        if m := re.match(LINE, line):
            s, p, o, value, datatype, lang = m.groups()
            literal = o is None
            kind = ("rdf:langString" if lang else name(datatype) if datatype else "xsd:string") if literal else None
            out.append((name(s.strip("<>")), name(p), value if literal else name(o.strip("<>")), literal, kind))
        elif not re.match(BLANK, line):
            bad.append(line)
    return out, bad


def without_entities(text: str) -> str:
    """XML with its internal entities put in and its document type gone."""
    if re.search(r"<!ENTITY\s+%", text) or text.count("<!ENTITY") > 1000:
        raise OntologyError("entities are not allowed")
    for entity, value in re.findall(r"<!ENTITY\s+(\S+)\s+\"([^\"]*)\"\s*>", text):
        text = text.replace(f"&{entity};", value)
    return re.sub(r"<!DOCTYPE[^\[>]*(\[.*?\])?\s*>", "", text, count=1, flags=re.S)


def parse_rdfxml(text: str) -> list[tuple]:
    """Triples of an RDF/XML text: typed nodes, property attributes, nesting, collections, literals."""
    root = ET.fromstring(without_entities(text))
    rdf, xml = PREFIXES["rdf"], "http://www.w3.org/XML/1998/namespace"
    base = root.get(f"{{{xml}}}base", "")
    out, fresh = [], [0]

    def short_name(iri):
        return next((f"{p}:{iri[len(b) :]}" for p, b in PREFIXES.items() if iri.startswith(b)), iri)

    def tag_iri(tag):
        ns, _, local = tag[1:].partition("}")
        return short_name(ns + local)

    def resolve(iri):
        return short_name(iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base.rstrip("#") + ("#" + iri.lstrip("#") if iri else ""))

    def blank():
        fresh[0] += 1
        return f"_:x{fresh[0]}"

    def subject_of(e):
        if (v := e.get(f"{{{rdf}}}about")) is not None:
            return resolve(v)
        if (v := e.get(f"{{{rdf}}}ID")) is not None:
            return resolve("#" + v)
        return f"_:{v}" if (v := e.get(f"{{{rdf}}}nodeID")) is not None else blank()

    def node(e):
        s = subject_of(e)
        if e.tag != f"{{{rdf}}}Description":
            out.append((s, "rdf:type", tag_iri(e.tag), False, None))
        for k, v in e.attrib.items():
            if not k.startswith(f"{{{rdf}}}") and not k.startswith(f"{{{xml}}}") and k.startswith("{"):
                out.append((s, tag_iri(k), v, True, "xsd:string"))
        for p in e:
            prop, kind = tag_iri(p.tag), p.get(f"{{{rdf}}}parseType")
            if (v := p.get(f"{{{rdf}}}resource")) is not None:
                out.append((s, prop, resolve(v), False, None))
            elif (v := p.get(f"{{{rdf}}}nodeID")) is not None:
                out.append((s, prop, f"_:{v}", False, None))
            elif kind == "Collection":
                last = "rdf:nil"
                for item in reversed([node(x) for x in p]):
                    cell = blank()
                    out.extend([(cell, "rdf:first", item, False, None), (cell, "rdf:rest", last, False, None)])
                    last = cell
                out.append((s, prop, last, False, None))
            elif kind == "Literal":
                out.append((s, prop, "".join(ET.tostring(x, encoding="unicode") for x in p), True, "rdf:XMLLiteral"))
            elif kind == "Resource" or len(p):
                for x in [p] if kind == "Resource" else p:
                    out.append((s, prop, node(x), False, None))
            else:
                datatype = p.get(f"{{{rdf}}}datatype")
                out.append((s, prop, p.text or "", True, resolve(datatype) if datatype else ("rdf:langString" if p.get(f"{{{xml}}}lang") else "xsd:string")))
        return s

    for e in root if root.tag == f"{{{rdf}}}RDF" else [root]:
        node(e)
    return out


SCHEMA = "s string, p string, o string, o_is_literal boolean, datatype string"


def read_document(spark: SparkSession, path: str, base: str | None = None, imports: bool = True, lenient: bool = False, _seen: frozenset = frozenset()) -> DataFrame:
    """Triples of one local file and of the local files it imports.  Remote imports are never fetched;
    with ``base``, files outside that directory are refused, and links are not followed."""
    real = os.path.realpath(path)
    if base is not None and os.path.commonpath([real, os.path.realpath(base)]) != os.path.realpath(base):
        raise OntologyError(f"{path} lies outside {base}")
    with os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
        raw = f.read(MAX_BYTES + 1)
    if len(raw) > MAX_BYTES:
        raise OntologyError("document too large")
    text = raw.decode("utf-8", "replace")
    kind = detect(text, path)
    if kind == "ntriples":
        return read_ntriples(spark, path, lenient)
    if kind not in ("turtle", "rdfxml"):
        raise OntologyError(f"{kind} holds no triples")
    rows = parse_turtle(text) if kind == "turtle" else parse_rdfxml(text)
    out = spark.createDataFrame(rows, SCHEMA)
    if imports:
        for _, _, target, _, _ in [r for r in rows if r[1] == "owl:imports"]:
            local = os.path.join(os.path.dirname(real), os.path.basename(target.removeprefix("file://")))
            if os.path.exists(local) and os.path.realpath(local) not in _seen | {real}:
                out = out.unionByName(read_document(spark, local, base, True, lenient, _seen | {real})).distinct()
    return out
