"""One document of any format as axioms: functional syntax, OWL/XML, RDF/XML, Turtle or N-Triples, with its imports."""
from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET

from taxoflux.ontology import OntologyError, check_iri
from taxoflux.sources import functional, graph_axioms, rdf
from taxoflux.sources.functional import KINDS, PREFIXES, Document

FOLDER_FILES = 1_000  # of a folder that are looked at for an import's name


def short_name(iri: str) -> str:
    return next((f"{p}:{iri[len(b) :]}" for p, b in PREFIXES.items() if iri.startswith(b)), None) or check_iri(iri)


def parse_owlxml(text: str, lenient: bool = False) -> Document:
    """OWL/XML: its elements are the functional syntax's words."""
    root = ET.fromstring(rdf.without_entities(text))
    local = lambda e: e.tag.rpartition("}")[2]
    base = root.get("{http://www.w3.org/XML/1998/namespace}base") or root.get("ontologyIRI") or ""
    prefixes = dict(PREFIXES) | {e.get("name"): e.get("IRI") for e in root if local(e) == "Prefix"}
    doc = Document(iri=root.get("ontologyIRI") or "")

    def name(e) -> str:
        if (iri := e.get("IRI")) is not None:
            return short_name(iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else base + iri)
        prefix, _, rest = (e.get("abbreviatedIRI") or "").partition(":")
        if prefix not in prefixes:
            raise OntologyError(f"unknown prefix {prefix!r}")
        return short_name(prefixes[prefix] + rest)

    def term(e):
        tag, inner = local(e), [x for x in e if local(x) != "Annotation"]
        if tag in KINDS:
            return name(e)
        if tag == "Variable":
            return ("Variable", name(e))
        if tag == "AnonymousIndividual":
            return f"_:{e.get('nodeID')}"
        if tag == "Literal":
            kind = e.get("datatypeIRI")
            return ("literal", e.text or "", short_name(kind) if kind else "rdf:langString" if e.get("{http://www.w3.org/XML/1998/namespace}lang") else "xsd:string")
        if tag == "HasKey":
            lists = {k: ("list", *(term(x) for x in inner[1:] if (local(x) == "DataProperty") == k)) for k in (False, True)}
            return (tag, term(inner[0]), lists[False], lists[True])
        if tag == "BuiltInAtom":
            return (tag, name(e), *map(term, inner))
        if tag == "FacetRestriction":
            return (tag, short_name(e.get("facet")), term(inner[0]))
        number = (int(e.get("cardinality")),) if "cardinality" in e.attrib else ()
        return (tag, *number, *map(term, inner))

    for e in root:
        if local(e) in ("Prefix", "Annotation"):
            continue
        try:
            if local(e) == "Import":
                doc.imports.append((e.text or "").strip())
            elif local(e) == "Declaration":
                doc.entities.append((name(e[0]), KINDS[local(e[0])]))
            else:
                functional._take(doc, term(e))
        except (OntologyError, KeyError, IndexError, TypeError, ValueError) as error:
            if not lenient:
                raise error if isinstance(error, OntologyError) else OntologyError(f"cannot read {local(e)}: {error}") from error
            doc.skipped.append(f"{local(e)}: {error}")
    return doc


def read_text(text: str, path: str = "", lenient: bool = False) -> Document:
    kind = rdf.detect(text, path)
    if kind == "functional":
        return functional.parse(text, lenient)
    if kind == "owlxml":
        return parse_owlxml(text, lenient)
    if kind == "ntriples":
        triples, bad = rdf.parse_ntriples(text)
        if bad and not lenient:
            raise OntologyError(f"cannot read {bad[0][:60]!r}")
    else:
        triples, bad = (rdf.parse_turtle(text) if kind == "turtle" else rdf.parse_rdfxml(text)), []
    doc = graph_axioms.document(triples)
    doc.skipped += bad
    doc.iri = next((s for s, p, o, *_ in triples if p == "rdf:type" and o == "owl:Ontology"), "")
    return doc


def _bytes(path: str, base: str | None) -> str:
    real = os.path.realpath(path)
    if base is not None and os.path.commonpath([real, os.path.realpath(base)]) != os.path.realpath(base):
        raise OntologyError(f"{path} lies outside {base}")
    with os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
        raw = f.read(rdf.MAX_BYTES + 1)
    if len(raw) > rdf.MAX_BYTES:
        raise OntologyError("document too large")
    return raw.decode("utf-8", "replace")


def find_import(iri: str, folder: str) -> str | None:
    """The file of a folder that an import means: the one of its last name, else one that gives itself that name."""
    iri = iri.strip("<>")
    plain = os.path.join(folder, os.path.basename(iri.removeprefix("file://")))
    if os.path.isfile(plain):
        return plain
    for entry in sorted(os.listdir(folder))[:FOLDER_FILES]:
        path = os.path.join(folder, entry)
        if os.path.isfile(path) and not os.path.islink(path):
            with open(path, "rb") as f:
                head = f.read(65_536).decode("utf-8", "replace")
            if re.search(r"Ontology\s*\(\s*<" + re.escape(iri) + ">", head) or re.search(r"(owl:Ontology[^>]*rdf:about|ontologyIRI)=\"" + re.escape(iri) + '"', head) or re.search("<" + re.escape(iri) + r">\s+(a|rdf:type|<[^>]*#type>)\s+(owl:Ontology|<[^>]*#Ontology>)", head):
                return path
    return None


def read(path: str, lenient: bool = False, base: str | None = None, imports: bool = True, _seen: frozenset = frozenset()) -> Document:
    """A local file and what it imports from its own folder.  Remote imports are never fetched; those not found are noted in
    ``skipped``.  With ``base``, files outside that directory are refused; links are not followed."""
    real = os.path.realpath(path)
    doc = read_text(_bytes(path, base), path, lenient)
    for iri in doc.imports if imports else ():
        found = find_import(iri, os.path.dirname(real))
        if found is None:
            doc.skipped.append(f"import not found: {iri}")
        elif os.path.realpath(found) not in _seen | {real}:
            more = read(found, lenient, base, True, _seen | {real})
            doc.axioms += [a for a in more.axioms if a not in doc.axioms]
            doc.entities += more.entities
            doc.skipped += more.skipped
    return doc
