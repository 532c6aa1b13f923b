"""DL-safe rules: a small rule language compiled to joins and run to a fixpoint.

``Type(?x, Order) & placedBy(?x, ?y) & value(?x, price, ?v) & ?v >= 100 -> Type(?y, Buyer)``.
Atoms: Type, object properties, value (data properties, numeric), comparisons of a bound variable with a
number, sameAs, differentFrom.  Heads: Type, object properties, sameAs, value.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoflux.plans.fixpoint import Result, Rule, fixpoint
from taxoflux.plans.scratch import Scratch

c = F.col
CALL = re.compile(r"([A-Za-z][\w:./#-]*)\(([^()]*)\)$")
COMPARE = re.compile(r"\?(\w+)\s*(<=|>=|=|!=|<|>)\s*(-?[0-9.]+)$")
#: predicate -> (relation, columns)
SHAPES = {"Type": ("type", ("ind", "cls")), "sameAs": ("same", ("a", "b")), "differentFrom": ("different", ("a", "b")), "value": ("dpa", ("s", "p", "v"))}


#: Columns that hold individuals.
NAMED = {"type": ("ind",), "opa": ("s", "o"), "dpa": ("s",), "same": ("a", "b"), "different": ("a", "b")}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    relation: str
    columns: tuple[str, ...]
    args: tuple[str, ...]


def parse_atom(text: str) -> Term | tuple[str, str, float]:
    text = text.strip()
    if m := COMPARE.match(text):
        return m[1], m[2], float(m[3])
    if not (m := CALL.match(text)):
        raise RuleError(f"cannot read atom {text!r}")
    args = tuple(a.strip() for a in m[2].split(","))
    if m[1] in SHAPES:
        relation, columns = SHAPES[m[1]]
        if len(args) != len(columns):
            raise RuleError(f"{m[1]} takes {len(columns)} arguments")
        return Term(relation, columns, args)
    if len(args) != 2:
        raise RuleError(f"{m[1]} takes 2 arguments")
    return Term("opa", ("s", "p", "o"), (args[0], m[1], args[1]))


def rows_of(term: Term, df: DataFrame) -> DataFrame:
    out, seen = [], {}
    for column, arg in zip(term.columns, term.args):
        if arg.startswith("?"):
            if arg in seen:
                df = df.where(c(column) == c(seen[arg]))
            else:
                seen[arg] = column
                out.append(c(column).alias(arg[1:]))
        else:
            df = df.where(c(column) == F.lit(arg))
    return df.select(*out).distinct()


def compile_rule(name: str, text: str) -> Rule:
    """A rule as a fixpoint rule.  Head variables must be bound in the body (DL safety)."""
    body, arrow, head = text.partition("->")
    if not arrow:
        raise RuleError("a rule needs ->")
    return build(name, [parse_atom(a) for a in body.split("&")], parse_atom(head))


# Built-in comparisons and the operators they stand for.
BUILTINS = {"equal": "=", "notEqual": "!=", "lessThan": "<", "lessThanOrEqual": "<=", "greaterThan": ">", "greaterThanOrEqual": ">="}
MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def rules_of_axiom(axiom: tuple, name: str, normal) -> list[Rule]:
    """A DLSafeRule of the functional syntax, one rule for each atom of its head.  Class expressions in atoms get names by ``normal``
    (sources.normal.Normal), which notes their meaning."""

    def term(x) -> str:
        return "?" + re.sub(r"\W", "_", x[1]) if isinstance(x, tuple) and x[0] == "Variable" else x[1] if isinstance(x, tuple) else x

    def atom(x, body: bool):
        op, args = x[0], x[1:]
        if op == "ClassAtom":
            return Term("type", ("ind", "cls"), (term(args[1]), normal.upper(args[0]) if body else normal.lower(args[0])))
        if op == "ObjectPropertyAtom":
            return Term("opa", ("s", "p", "o"), (term(args[1]), normal.role(args[0]), term(args[2])))
        if op == "DataPropertyAtom":
            if not body:
                raise RuleError("data values in heads are not built")
            return Term("dpa", ("s", "p", "lexical"), (term(args[1]), args[0], term(args[2])))
        if op in ("SameIndividualAtom", "DifferentIndividualsAtom"):
            return Term("same" if op[0] == "S" else "different", ("a", "b"), tuple(map(term, args)))
        if op == "BuiltInAtom" and (sign := BUILTINS.get(re.split("[#:]", args[0])[-1])) and len(args) == 3:
            left, right = map(term, args[1:])
            if right.startswith("?"):
                left, right, sign = right, left, MIRRORED.get(sign, sign)
            return left[1:], sign, float(right)
        raise RuleError(f"{op} is not built")

    body, head = axiom[1:]
    atoms = [atom(x, True) for x in body[1:]]
    return [build(f"{name}.{i}", atoms, atom(x, False)) for i, x in enumerate(head[1:])]


def build(name: str, atoms: list, goal: Term) -> Rule:
    terms = [a for a in atoms if isinstance(a, Term)]
    tests = [a for a in atoms if not isinstance(a, Term)]
    bound = {x[1:] for t in terms for x in t.args if x.startswith("?")}
    if not isinstance(goal, Term) or not terms:
        raise RuleError("head and body need atoms")
    if free := {x[1:] for x in goal.args if x.startswith("?")} - bound | {v for v, _, _ in tests} - bound:
        raise RuleError(f"unbound variables {sorted(free)}")

    def run(*args: DataFrame) -> DataFrame:
        todo = [rows_of(t, df) for t, df in zip(terms, args)]
        out = todo.pop(0)
        while todo:
            i = next((i for i, r in enumerate(todo) if set(r.columns) & set(out.columns)), None)
            if i is None:
                raise RuleError("body atoms share no variable")
            rows = todo.pop(i)
            out = out.join(rows, [x for x in rows.columns if x in out.columns])
        for v, op, number in tests:
            column = c(v).try_cast("double")
            out = out.where({"<": column < number, "<=": column <= number, ">": column > number, ">=": column >= number, "=": column == number, "!=": column != number}[op])
        return out.select(*[(c(a[1:]) if a.startswith("?") else F.lit(a)).alias(k) for k, a in zip(goal.columns, goal.args)]).distinct()

    named = sorted({a for t in [*terms, goal] for column, a in zip(t.columns, t.args) if column in NAMED.get(t.relation, ()) and not a.startswith("?")})

    def renamed(names: dict[str, str]) -> Rule:
        """The rule with other names for individuals, such as their representatives."""
        other = lambda t: Term(t.relation, t.columns, tuple(names.get(a, a) if column in NAMED.get(t.relation, ()) else a for column, a in zip(t.columns, t.args)))
        return build(name, [other(a) if isinstance(a, Term) else a for a in atoms], other(goal))

    return Rule(name, goal.relation, tuple(t.relation for t in terms), run, tuple(named), renamed)


def apply_rules(rel: dict[str, DataFrame], rules: dict[str, str], scratch: Scratch, max_rounds: int = 64, max_rows: int | None = None, trace: bool = False) -> Result:
    return fixpoint(rel, [compile_rule(k, v) for k, v in rules.items()], scratch, max_rounds, max_rows, trace)
