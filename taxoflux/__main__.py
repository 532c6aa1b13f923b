"""python -m taxoflux COMMAND FILE [ARG...]: profile, classify, materialize, explain, query, instances,
consistent, entail, subproperties, property-values over a document in functional syntax, OWL/XML, RDF/XML, Turtle or N-Triples."""
from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from taxoflux.reasoner import Reasoner

COMMANDS = {"profile": 0, "classify": 0, "materialize": 0, "consistent": 0, "explain": 2, "query": 1, "instances": 1, "entail": 1, "subproperties": 1, "property-values": 2}


def answer(r: Reasoner, command: str, args: list[str]):
    rows = lambda df: sorted([list(x) for x in df.collect()])  # noqa: E731  an answer to print
    if command == "profile":
        route = r.route()
        return {"profile": route.profile, "engine": route.engine, "violations": route.violations}
    if command == "classify":
        t = r.classify()
        return {"complete": t.complete, "subsumptions": rows(t.direct), "equivalent": rows(t.equivalent), "unsatisfiable": [x for (x,) in rows(t.unsatisfiable)]}
    if command == "materialize":
        done = r.materialize()
        return {"counts": done.counts, "rounds": done.rounds, "types": rows(r._types()), "facts": rows(done.expanded("opa"))}
    if command == "consistent":
        return dict(zip(("consistent", "complete", "reason"), r.consistency()))
    if command == "explain":
        return r.explain(*args)
    if command == "entail":
        return {"entailed": r.entails(*args)}
    found = {"query": r.query, "instances": r.instances, "subproperties": r.sub_properties, "property-values": r.property_values}[command](*args)
    return rows(found)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="taxoflux", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("file")
    parser.add_argument("args", nargs="*")
    parser.add_argument("--lenient", action="store_true", help="skip what cannot be read")
    given = parser.parse_args(argv)
    if len(given.args) != COMMANDS[given.command]:
        parser.error(f"{given.command} takes {COMMANDS[given.command]} arguments")
    spark = SparkSession.builder.appName("taxoflux").getOrCreate()
    r = Reasoner.load(spark, given.file, lenient=given.lenient)
    print(json.dumps(answer(r, given.command, given.args), indent=1, ensure_ascii=False))


if __name__ == "__main__":
    main()
