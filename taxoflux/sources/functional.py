"""OWL functional syntax: a tokenizer and a reader of axioms.

Class expressions are nested tuples (op, ...), names are strings, a list in parentheses is ("list", ...).
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from taxoflux.ontology import Ontology, OntologyError, check_iri
from taxoflux.sources import normal

TOKEN = re.compile(r'\s+|#[^\n]*|(?P<p>[()=])|(?P<iri><[^<>\s]*>)|(?P<lit>"(?:[^"\\]|\\.)*")|(?P<at>\^\^|@[A-Za-z0-9-]+)|(?P<word>[^\s()=<>"^]+)')
# Well-known prefixes.
PREFIXES = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
KINDS = {"Class": "class", "ObjectProperty": "object_property", "DataProperty": "data_property", "NamedIndividual": "individual", "Datatype": "datatype", "AnnotationProperty": "annotation_property"}
MAX_DEPTH = 500


@dataclass
class Document:
    """What one text holds: axioms as tuples, declared entities, and what a lenient read skipped."""

    axioms: list[tuple] = field(default_factory=list)
    entities: list[tuple[str, str]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    iri: str = ""


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise OntologyError(f"cannot read {text[at : at + 30]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.prefixes = 0, dict(PREFIXES)

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self, value: str | None = None):
        kind, text = self.peek()
        if kind == "end" or value is not None and text != value:
            raise OntologyError(f"expected {value or 'more'}, found {text!r}")
        self.at += 1
        return kind, text

    def name(self, text: str) -> str:
        """A short name: well-known prefixes stay as they are, the default prefix and full IRIs lose theirs to full form."""
        if text.startswith("<"):
            iri = text[1:-1]
        else:
            prefix, colon, local = text.partition(":")
            if not colon:
                raise OntologyError(f"not a name: {text!r}")
            if prefix in PREFIXES:
                return f"{prefix}:{local}"
            if prefix not in self.prefixes:
                raise OntologyError(f"unknown prefix {prefix!r}")
            iri = self.prefixes[prefix] + local
        for prefix, base in PREFIXES.items():
            if iri.startswith(base):
                return f"{prefix}:{iri[len(base) :]}"
        return check_iri(iri)

    def term(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise OntologyError("nested too deeply")
        kind, text = self.next()
        if text == "(" and kind == "p":
            args = []
            while self.peek()[1] != ")":
                args.append(self.term(depth + 1))
            self.next(")")
            return ("list", *args)
        if kind == "lit":
            value = re.sub(r"\\(.)", r"\1", text[1:-1])
            if self.peek()[0] == "at":
                mark = self.next()[1]
                return ("literal", value, self.name(self.next()[1])) if mark == "^^" else ("literal", value, "rdf:langString", mark[1:])
            return ("literal", value, "xsd:string")
        if kind == "word" and ":" not in text and self.peek()[1] == "(":
            self.next("(")
            args = []
            while self.peek()[1] != ")":
                args.append(self.term(depth + 1))
            self.next(")")
            return (text, *args)
        if kind == "word" and text.isdigit():
            return int(text)
        return self.name(text)


    def skip(self, start: int) -> str:
        """Goes on after the axiom that began at ``start``, whose parentheses need not match those read so far."""
        self.at, depth = start, 0
        while self.peek()[0] != "end":
            mark = self.next()[1]
            depth += (mark == "(") - (mark == ")")
            if mark == ")" and depth <= 0:
                break
        return " ".join(text for _, text in self.tokens[start : self.at])[:200]


def parse(text: str, lenient: bool = False) -> Document:
    """Reads a document.  Lenient reading notes the axioms that it can't read and goes on after each; letters that are
    no token are an error in both modes."""
    r, doc = _Reader(text), Document()
    while r.peek()[1] == "Prefix":
        r.next(), r.next("(")
        prefix = r.next()[1].rstrip(":") if r.peek()[1] != "=" else ""
        r.next("=")
        r.prefixes[prefix] = r.next()[1][1:-1]
        r.next(")")
    if r.peek()[1] == "Ontology":
        r.next(), r.next("(")
        while r.peek()[0] == "iri":
            doc.iri = doc.iri or r.peek()[1][1:-1]
            r.next()
    while r.peek()[0] == "word":
        start = r.at
        try:
            axiom = r.term()
            if not isinstance(axiom, tuple):
                raise OntologyError(f"not an axiom: {axiom!r}")
            axiom = (axiom[0], *(a for a in axiom[1:] if not (isinstance(a, tuple) and a[0] == "Annotation")))
            _take(doc, axiom)
        except (OntologyError, KeyError, IndexError, TypeError) as e:
            if not lenient:
                raise e if isinstance(e, OntologyError) else OntologyError(f"cannot read an axiom: {e}") from e
            doc.skipped.append(f"{e}: {r.skip(start)}")
    return doc


def _take(doc: Document, axiom: tuple) -> None:
    if axiom[0] == "Declaration":
        doc.entities.append((axiom[1][1], KINDS[axiom[1][0]]))
    elif axiom[0] == "Import":
        doc.imports.append(axiom[1])
    elif axiom[0] in AXIOMS:
        few, many = AXIOMS[axiom[0]]
        if not few <= len(axiom) - 1 <= many:
            raise OntologyError(f"{axiom[0]} takes other operands")
        doc.axioms.append(axiom)
    elif not axiom[0].startswith("Annotation") and axiom[0] not in ("SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange"):
        raise OntologyError(f"no such axiom: {axiom[0]}")


MANY = 1 << 30
# The axioms of OWL 2 and how many operands they take.
AXIOMS = {
    "SubClassOf": (2, 2), "EquivalentClasses": (2, MANY), "DisjointClasses": (2, MANY), "DisjointUnion": (3, MANY), "SubObjectPropertyOf": (2, 2), "EquivalentObjectProperties": (2, MANY), "DisjointObjectProperties": (2, MANY),
    "InverseObjectProperties": (2, 2), "ObjectPropertyDomain": (2, 2), "ObjectPropertyRange": (2, 2), "FunctionalObjectProperty": (1, 1), "InverseFunctionalObjectProperty": (1, 1), "ReflexiveObjectProperty": (1, 1),
    "IrreflexiveObjectProperty": (1, 1), "SymmetricObjectProperty": (1, 1), "AsymmetricObjectProperty": (1, 1), "TransitiveObjectProperty": (1, 1), "SubDataPropertyOf": (2, 2), "EquivalentDataProperties": (2, MANY),
    "DisjointDataProperties": (2, MANY), "DataPropertyDomain": (2, 2), "DataPropertyRange": (2, 2), "FunctionalDataProperty": (1, 1), "DatatypeDefinition": (2, 2), "HasKey": (3, 3), "SameIndividual": (2, MANY),
    "DifferentIndividuals": (2, MANY), "ClassAssertion": (2, 2), "ObjectPropertyAssertion": (3, 3), "NegativeObjectPropertyAssertion": (3, 3), "DataPropertyAssertion": (3, 3), "NegativeDataPropertyAssertion": (3, 3), "DLSafeRule": (2, 2),
}


def relations(doc: Document) -> tuple[dict[str, list[tuple]], list[tuple]]:
    """(rows per relation, axioms that relations don't hold in full)"""
    return normal.relations(doc.axioms)


def load(spark, text: str, lenient: bool = False) -> tuple[Ontology, list[tuple]]:
    """(ontology, axioms that only the tableau can use)"""
    doc = parse(text, lenient)
    rows, rest = relations(doc)
    return Ontology.of_rows(spark, rows, doc.entities), rest


def load_files(spark, path: str):
    """Many documents at once: (path, axiom as text) rows, parsed where they are read; bad ones give an error row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for where, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(where, repr(a), None) for a in parse(text).axioms]
                except OntologyError as e:
                    out.append((where, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else ([], [], []))], names=["path", "axiom", "error"])

    from pyspark.sql import functions as F

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(run, "path string, axiom string, error string")
