"""Satisfiability in a description logic with inverse and transitive roles, role hierarchies, acyclic role chains, disjoint
roles, self restrictions, nominals and qualified number restrictions, by tableau; and its distribution as
independent tests.

Concepts are tuples in negation normal form: ("top",), ("bottom",), ("name", A), ("not", A), ("one", i), ("notone", i),
("and", ...), ("or", ...), ("some", R, C), ("all", R, C), ("self", R), ("noself", R), ("min", n, R, C), ("max", n, R, C).  A
role is a name, or ("inv", name).  Constructs outside (keys, data ranges, cyclic chains, nominals together
with inverses and number restrictions) make an answer "incomplete" where they could matter, as do the
limits on time and nodes.
"""
from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TOP, BOTTOM = ("top",), ("bottom",)
OPPOSITE = {"one": "notone", "notone": "one", "self": "noself", "noself": "self"}


class Incomplete(Exception):
    """A limit was reached or a construct isn't covered."""


def inverse(r):
    return r[1] if isinstance(r, tuple) else ("inv", r)


def nnf(c, negate: bool = False):
    """Negation normal form of a concept written with ("not", any)."""
    op = c[0]
    if op == "not" and isinstance(c[1], tuple):
        return nnf(c[1], not negate)
    if op == "not":
        return ("name", c[1]) if negate else c
    if op in OPPOSITE:
        return (OPPOSITE[op], c[1]) if negate else c
    if op in ("top", "bottom"):
        return c if not negate else BOTTOM if op == "top" else TOP
    if op == "name":
        return ("not", c[1]) if negate else c
    if op in ("and", "or"):
        parts = tuple(sorted({nnf(x, negate) for x in c[1:]}, key=repr))
        return (op if not negate else "or" if op == "and" else "and", *parts)
    if op in ("some", "all"):
        return (op if not negate else "all" if op == "some" else "some", c[1], nnf(c[2], negate))
    if op == "min":
        filler = nnf(c[3])
        return ("min", *c[1:3], filler) if not negate else BOTTOM if c[1] == 0 else ("max", c[1] - 1, c[2], filler)
    if op == "max":
        return ("max", *c[1:3], nnf(c[3])) if not negate else ("min", c[1] + 1, c[2], nnf(c[3]))
    raise Incomplete(f"no rule for {op}")


@dataclass
class Knowledge:
    """unfold: A -> concepts that follow from it; general: concepts that hold everywhere; roles: closed
    super-roles of each role (itself and inverses included); transitive role names."""

    unfold: dict[str, list] = field(default_factory=dict)
    general: list = field(default_factory=list)
    supers: dict = field(default_factory=dict)
    transitive: set = field(default_factory=set)
    #: pairs of roles that share no pair, and (steps, role) chains, inverses included
    apart: list = field(default_factory=list)
    chains: list = field(default_factory=list)

    def above(self, r) -> frozenset:
        return self.supers.get(r, frozenset((r,)))

    def is_transitive(self, r) -> bool:
        return (r[1] if isinstance(r, tuple) else r) in self.transitive


def knowledge(axioms: Iterable[tuple], sub_roles: Iterable[tuple] = (), transitive: Iterable[str] = (), inverses: Iterable[tuple] = ()) -> Knowledge:
    """axioms: (sub, sup) concepts.  A name on the left unfolds when it shows up; all else holds everywhere."""
    k = Knowledge(transitive=set(transitive))
    for sub, sup in axioms:
        if sub[0] == "name":
            k.unfold.setdefault(sub[1], []).append(nnf(sup))
        else:
            k.general.append(nnf(("or", ("not", sub) if sub[0] != "not" else nnf(sub, True), sup)))
    edges: dict = {}
    pairs = [*sub_roles, *((p, inverse(q)) for p, q in inverses), *((inverse(q), p) for p, q in inverses)]
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
        edges.setdefault(inverse(a), set()).add(inverse(b))
    for r in set(edges) | {x for v in edges.values() for x in v}:
        seen, todo = {r}, [r]
        while todo:
            for b in edges.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        k.supers[r] = frozenset(seen)
    return k


class _Graph:
    """One branch: labels, edges and inequalities.  Copied where a choice is made."""

    __slots__ = ("labels", "edges", "parent", "apart", "alive")

    def __init__(self):
        self.labels: list[set] = []
        self.edges: dict[tuple[int, int], set] = {}
        self.parent: list[int | None] = []
        self.apart: set[frozenset] = set()
        self.alive: list[bool] = []

    def copy(self):
        g = _Graph()
        g.labels = [set(x) for x in self.labels]
        g.edges = {k: set(v) for k, v in self.edges.items()}
        g.parent, g.apart, g.alive = list(self.parent), set(self.apart), list(self.alive)
        return g

    def node(self, parent=None) -> int:
        self.labels.append(set())
        self.parent.append(parent)
        self.alive.append(True)
        return len(self.labels) - 1


class Tableau:
    def __init__(self, k: Knowledge, seconds: float = 10.0, nodes: int = 2_000):
        self.k, self.deadline, self.most = k, time.monotonic() + seconds, nodes

    def satisfiable(self, concepts: list, facts: Iterable[tuple] = (), types: Iterable[tuple] = (), different: Iterable[tuple] = ()) -> _Graph | None:
        """A clash-free complete branch with node 0 in all concepts (and named individuals as roots), or None."""
        g = _Graph()
        names: dict = {}

        def root(i):
            if i not in names:
                names[i] = g.node()
                if i is not None:
                    g.labels[names[i]].add(("one", i))
            return names[i]

        if concepts:
            root(None)
            g.labels[0].update(nnf(c) for c in concepts)
        for i, c in types:
            g.labels[root(i)].add(nnf(c))
        for s, r, o in facts:
            self._link(g, root(s), r, root(o))
        for a, b in different:
            g.apart.add(frozenset((root(a), root(b))))
        for i in sorted(_ones([*self.k.general, *(c for v in self.k.unfold.values() for c in v), *(c for x in g.labels for c in x)])):
            root(i)
        if not g.labels:
            root(None)
        branches = [g]
        while branches:
            g = branches.pop()
            choice = self._expand(g)
            if choice is None:
                return g
            branches += reversed(choice)  # empty on a clash
        return None

    def _link(self, g, a, r, b):
        g.edges.setdefault((a, b), set()).add(r)
        g.edges.setdefault((b, a), set()).add(inverse(r))

    def _neighbours(self, g, x, r):
        for (a, b), roles in g.edges.items():
            if a == x and g.alive[b] and any(r in self.k.above(s) for s in roles):
                yield b

    def _blocked(self, g, x) -> bool:
        """Pairwise blocking by an ancestor, for x or a node above it."""
        while x is not None and g.parent[x] is not None:
            p, y = g.parent[x], g.parent[x]
            while y is not None and g.parent[y] is not None:
                q = g.parent[y]
                if g.labels[x] == g.labels[y] and g.labels[p] == g.labels[q] and g.edges.get((p, x)) == g.edges.get((q, y)):
                    return True
                y = q
            x = p
        return False

    def _expand(self, g):
        """Applies rules until nothing is left (None), a clash ([]) or a choice (branches)."""
        k = self.k
        while True:
            if time.monotonic() > self.deadline or len(g.labels) > self.most:
                raise Incomplete("limit reached")
            changed = False
            for x in range(len(g.labels)):
                if not g.alive[x]:
                    continue
                label = g.labels[x]
                label.update(k.general)
                todo = list(label)
                while todo:
                    c = todo.pop()
                    more = c[1:] if c[0] == "and" else k.unfold.get(c[1], ()) if c[0] == "name" else ()
                    for m in more:
                        if m not in label:
                            label.add(m)
                            todo.append(m)
                            changed = True
                if BOTTOM in label or any(c[0] == "not" and ("name", c[1]) in label or c[0] == "notone" and ("one", c[1]) in label for c in label):
                    return []
                loops = {t for s in g.edges.get((x, x), ()) for t in k.above(s)}
                for c in [c for c in label if c[0] in ("self", "noself") and (c[0] == "self") != (c[1] in loops)]:
                    if c[0] == "noself":
                        return []
                    self._link(g, x, c[1], x)
                    changed = True
            if k.apart:
                for roles in g.edges.values():
                    held = {t for s in roles for t in k.above(s)}
                    if any(r in held and s in held for r, s in k.apart):
                        return []
            owner: dict = {}
            for x in [i for i in range(len(g.labels)) if g.alive[i]]:
                for c in g.labels[x]:
                    if c[0] == "one" and owner.setdefault(c[1], x) != x:
                        return [self._merged(g, owner[c[1]], x)]
            for x in [i for i in range(len(g.labels)) if g.alive[i]]:
                for c in [c for c in g.labels[x] if c[0] == "all"]:
                    for steps, over in k.chains:
                        if c[1] in k.above(over):
                            inner = c[2]
                            for r in reversed(steps):
                                inner = ("all", r, inner)
                            if inner not in g.labels[x]:
                                g.labels[x].add(inner)
                                changed = True
                    for y in list(self._neighbours(g, x, c[1])):
                        if c[2] not in g.labels[y]:
                            g.labels[y].add(c[2])
                            changed = True
                    for s in {s for roles in (v for (a, _), v in g.edges.items() if a == x) for t in roles for s in k.above(t) if k.is_transitive(s) and c[1] in k.above(s)}:
                        for y in list(self._neighbours(g, x, s)):
                            if ("all", s, c[2]) not in g.labels[y]:
                                g.labels[y].add(("all", s, c[2]))
                                changed = True
            if changed:
                continue
            for x in [i for i in range(len(g.labels)) if g.alive[i]]:
                for c in sorted((c for c in g.labels[x] if c[0] == "or"), key=len):
                    if not any(d in g.labels[x] or d == TOP for d in c[1:]):
                        return [self._with(g, x, d) for d in c[1:]]
                for c in [c for c in g.labels[x] if c[0] == "max"]:
                    near = list(dict.fromkeys(self._neighbours(g, x, c[2])))
                    no = nnf(c[3], True)
                    for y in near:  # every neighbour is in the filler or out of it
                        if c[3] != TOP and c[3] not in g.labels[y] and no not in g.labels[y]:
                            return [self._with(g, y, c[3]), self._with(g, y, no)]
                    inside = [y for y in near if c[3] == TOP or c[3] in g.labels[y]]
                    if len(inside) > c[1]:
                        merges = [(a, b) for i, a in enumerate(inside) for b in inside[i + 1 :] if frozenset((a, b)) not in g.apart]
                        return [self._merged(g, a, b) for a, b in merges]
            made = False
            for x in [i for i in range(len(g.labels)) if g.alive[i]]:
                if self._blocked(g, x):
                    continue
                for c in sorted((c for c in g.labels[x] if c[0] in ("some", "min")), key=repr):
                    n, r, filler = (1, c[1], c[2]) if c[0] == "some" else c[1:]
                    have = [y for y in dict.fromkeys(self._neighbours(g, x, r)) if filler == TOP or filler in g.labels[y]]
                    if n == 0 or len(have) >= n and self._apart_enough(g, have, n):
                        continue
                    new = [g.node(x) for _ in range(n)]
                    for y in new:
                        self._link(g, x, r, y)
                        g.labels[y].add(filler)
                    g.apart.update(frozenset((a, b)) for i, a in enumerate(new) for b in new[i + 1 :])
                    made = True
                if made:
                    break
            if not made:
                return None

    def _apart_enough(self, g, nodes, n) -> bool:
        """Whether n of the nodes are pairwise apart (one node always is)."""
        if n == 1:
            return True
        picked: list[int] = []
        for y in nodes:
            if all(frozenset((y, z)) in g.apart for z in picked):
                picked.append(y)
        return len(picked) >= n

    def _with(self, g, x, c):
        g = g.copy()
        g.labels[x].add(c)
        return g

    def _merged(self, g, a, b):
        """b becomes a (roots and older nodes stay); what grew below b goes."""
        if g.parent[a] is not None and g.parent[b] is None or b < a and (g.parent[a] is None) == (g.parent[b] is None):
            a, b = b, a
        g = g.copy()
        g.labels[a] |= g.labels[b]
        for (x, y), roles in list(g.edges.items()):
            if x == b and g.alive[y] and g.parent[y] != b:
                for r in roles:
                    self._link(g, a, r, a if y == b else y)
        gone = [b]
        while gone:
            z = gone.pop()
            g.alive[z] = False
            gone += [y for y in range(len(g.labels)) if g.alive[y] and g.parent[y] == z]
            g.edges = {e: v for e, v in g.edges.items() if z not in e}
        g.apart |= {frozenset(a if z == b else z for z in pair) for pair in g.apart if b in pair}
        if any(len(p) < 2 for p in g.apart):
            g.labels[a].add(BOTTOM)
        return g


def _ones(concepts) -> set:
    """Individuals that concepts name."""
    out: set = set()
    for c in concepts:
        if c[0] in ("one", "notone"):
            out.add(c[1])
        elif c[0] in ("and", "or"):
            out |= _ones(c[1:])
        elif c[0] in ("some", "all", "min", "max"):
            out |= _ones(c[-1:])
    return out


# ---- from axioms of the functional syntax ---------------------------------------------------------
def concept(x):
    """A class expression of the functional syntax as a concept."""
    if isinstance(x, str):
        return TOP if x == "owl:Thing" else BOTTOM if x == "owl:Nothing" else ("name", x)
    op, args = x[0], x[1:]
    if op == "ObjectComplementOf":
        return ("not", concept(args[0]))
    if op in ("ObjectIntersectionOf", "ObjectUnionOf"):
        return ("and" if op == "ObjectIntersectionOf" else "or", *(concept(a) for a in args))
    if op in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
        return ("some" if op == "ObjectSomeValuesFrom" else "all", role(args[0]), concept(args[1]))
    if op == "ObjectOneOf":
        return ("one", args[0]) if len(args) == 1 else ("or", *(("one", a) for a in args))
    if op == "ObjectHasValue":
        return ("some", role(args[0]), ("one", args[1]))
    if op == "ObjectHasSelf":
        return ("self", role(args[0]))
    if op in ("ObjectMinCardinality", "ObjectMaxCardinality", "ObjectExactCardinality"):
        n, r, filler = args[0], role(args[1]), concept(args[2]) if len(args) > 2 else TOP
        least, most = ("min", n, r, filler), ("max", n, r, filler)
        return least if "Min" in op else most if "Max" in op else ("and", least, most)
    raise Incomplete(f"{op} is not covered")


def role(r):
    return inverse(role(r[1])) if isinstance(r, tuple) and r[0] == "ObjectInverseOf" else r


#: Axioms about data values; they are decided by joins (rl.clashes) as long as no class is defined by data.
DATA = ("DataPropertyAssertion", "NegativeDataPropertyAssertion", "SubDataPropertyOf", "EquivalentDataProperties", "DisjointDataProperties", "FunctionalDataProperty", "DataPropertyDomain", "DataPropertyRange")


def from_axioms(axioms: Iterable[tuple]) -> tuple[Knowledge, dict[str, list], list[str]]:
    """(knowledge, {"types", "facts", "different"}, constructs left out) of functional-syntax axioms."""
    axioms = list(axioms)
    subs, roles, trans, inverses, left, apart, chains = [], [], [], [], [], [], []
    box: dict[str, list] = {"types": [], "facts": [], "different": []}
    for axiom in axioms:
        op, args = axiom[0], axiom[1:]
        try:
            if op == "SubClassOf":
                subs.append((concept(args[0]), concept(args[1])))
            elif op == "EquivalentClasses":
                c = [concept(a) for a in args]
                subs += [(c[i], c[(i + 1) % len(c)]) for i in range(len(c))]
            elif op in ("DisjointClasses", "DisjointUnion"):
                c = [concept(a) for a in args]
                if op == "DisjointUnion":
                    whole, c = c[0], c[1:]
                    subs += [(whole, ("or", *c)), *((x, whole) for x in c)]
                subs += [(a, ("not", b)) for i, a in enumerate(c) for b in c[i + 1 :]]
            elif op == "ObjectPropertyDomain":
                subs.append((("some", role(args[0]), TOP), concept(args[1])))
            elif op == "ObjectPropertyRange":
                subs.append((TOP, ("all", role(args[0]), concept(args[1]))))
            elif op in ("FunctionalObjectProperty", "InverseFunctionalObjectProperty"):
                r = role(args[0])
                subs.append((TOP, ("max", 1, r if op[0] == "F" else inverse(r), TOP)))
            elif op == "SubObjectPropertyOf" and isinstance(args[0], tuple) and args[0][0] == "ObjectPropertyChain":
                steps, over = tuple(role(r) for r in args[0][1:]), role(args[1])
                if steps == (over, over):
                    trans.append(over if isinstance(over, str) else over[1])
                else:
                    chains += [(steps, over), (tuple(inverse(r) for r in reversed(steps)), inverse(over))]
            elif op == "SubObjectPropertyOf":
                roles.append((role(args[0]), role(args[1])))
            elif op == "EquivalentObjectProperties":
                roles += [(role(args[i]), role(args[(i + 1) % len(args)])) for i in range(len(args))]
            elif op == "InverseObjectProperties":
                inverses.append((role(args[0]), role(args[1])))
            elif op == "SymmetricObjectProperty":
                roles.append((role(args[0]), inverse(role(args[0]))))
            elif op == "TransitiveObjectProperty":
                r = role(args[0])
                trans.append(r if isinstance(r, str) else r[1])
            elif op == "DisjointObjectProperties":
                apart += [(role(a), role(b)) for i, a in enumerate(args) for b in args[i + 1 :]]
            elif op == "AsymmetricObjectProperty":
                apart.append((role(args[0]), inverse(role(args[0]))))
            elif op in ("ReflexiveObjectProperty", "IrreflexiveObjectProperty"):
                subs.append((TOP, ("self" if op[0] == "R" else "noself", role(args[0]))))
            elif op == "ClassAssertion":
                box["types"].append((args[1], concept(args[0])))
            elif op == "ObjectPropertyAssertion":
                box["facts"].append((args[1], role(args[0]), args[2]))
            elif op == "NegativeObjectPropertyAssertion":
                box["types"].append((args[1], ("all", role(args[0]), ("notone", args[2]))))
            elif op == "SameIndividual":
                box["types"] += [(args[0], ("one", b)) for b in args[1:]]
            elif op == "DifferentIndividuals":
                box["different"] += [(a, b) for i, a in enumerate(args) for b in args[i + 1 :]]
            elif op not in DATA:
                left.append(op)
        except Incomplete:
            left.append(op)
    if _cyclic(chains, roles + [(p, inverse(q)) for p, q in inverses]):
        left.append("ObjectPropertyChain")
        chains = []
    text = repr(axioms)
    if any(x in text for x in ("ObjectOneOf", "ObjectHasValue")) and ("Inverse" in text or "Symmetric" in text) and ("Cardinality" in text or "Functional" in text):
        left.append("nominals with inverses and number restrictions")
    k = knowledge(subs, roles, trans, inverses)
    k.apart, k.chains = apart, chains
    return k, box, sorted(set(left))


def _cyclic(chains, edges) -> bool:
    """Whether a chain's step lies above the role that the chain makes (then propagation along chains would not end)."""
    up: dict = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
        up.setdefault(inverse(a), set()).add(inverse(b))
    for steps, over in chains:
        for r in steps:
            up.setdefault(r, set()).add(over)
    for steps, over in chains:
        seen, todo = set(), [over]
        while todo:
            for b in up.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if seen & set(steps):
            return True
    return False


def test(k: Knowledge, concepts: list, box: dict | None = None, seconds: float = 10.0, partial: bool = False) -> str:
    """satisfiable, unsatisfiable or incomplete.  With axioms left out (``partial``) only a clash is proof."""
    try:
        found = Tableau(k, seconds).satisfiable(concepts, **(box or {}))
    except Incomplete:
        return "incomplete"
    return "unsatisfiable" if found is None else "incomplete" if partial else "satisfiable"


def classify(spark: SparkSession, classes: DataFrame, k: Knowledge, seconds: float = 10.0, partial: bool = False) -> DataFrame:
    """(cls) -> (cls, status, sup): one independent task of tests per class, no pairs.

    The classes on the root of a model of C are the only ones that can be above C; each is then
    tested by refutation.  status is that of C; sup is null where nothing is above it."""
    sent = spark.sparkContext.broadcast(k)

    def run(frames):
        for frame in frames:
            out = []
            for cls in frame["cls"]:
                try:
                    model = Tableau(sent.value, seconds).satisfiable([("name", cls)])
                except Incomplete:
                    out.append((cls, "incomplete", None))
                    continue
                if model is None:
                    out.append((cls, "unsatisfiable", None))
                    continue
                status = "incomplete" if partial else "satisfiable"
                above = [c[1] for c in model.labels[0] if c[0] == "name" and c[1] != cls]
                sups = [a for a in sorted(above) if test(sent.value, [("name", cls), ("not", a)], seconds=seconds) == "unsatisfiable"]
                out += [(cls, status, a) for a in sups] or [(cls, status, None)]
            yield pd.DataFrame(out, columns=["cls", "status", "sup"])

    return classes.select("cls").repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "cls string, status string, sup string")


def consistent_components(spark: SparkSession, assertions: DataFrame, k: Knowledge, seconds: float = 10.0) -> DataFrame:
    """(component, kind, s, p, o) assertions -> (component, status): each connected part of the ABox is tested
    on its own.  kind: type (o is a class), fact, different.  A part is one task and held whole: one that
    passes the limits on nodes and time is incomplete, never guessed."""
    sent = spark.sparkContext.broadcast(k)

    def run(key, frame):
        rows = list(frame.itertuples(index=False))
        box = {
            "types": [(r.s, ("name", r.o)) for r in rows if r.kind == "type"],
            "facts": [(r.s, r.p, r.o) for r in rows if r.kind == "fact"],
            "different": [(r.s, r.o) for r in rows if r.kind == "different"],
        }
        return pd.DataFrame([(key[0], test(sent.value, [], box, seconds))], columns=["component", "status"])

    return assertions.groupBy("component").applyInPandas(run, "component string, status string")
