"""Command line: list queries, run one, explain its plan, ingest an ontology."""

from __future__ import annotations

import argparse

from . import catalog, session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="termloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name in ("run", "explain"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--data", required=True, help="folder of the Parquet tables")
        q.add_argument("--out", help="write Parquet here instead of showing rows")
        q.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    o = sub.add_parser("ontology", help="ingest an ontology file into a store")
    o.add_argument("file")
    o.add_argument("store")
    o.add_argument("--root", required=True)
    o.add_argument("--prefix", default="HP")
    o.add_argument("--sha256")
    a = p.parse_args(args)
    if a.command == "list":
        print(*sorted(catalog.queries()), sep="\n")
        return 0
    spark = session.build()
    if a.command == "ontology":
        from .sources import obo

        obo.prepare(spark, a.file, a.store, a.root, a.prefix, a.sha256)
        return 0
    found = catalog.queries().get(a.query)
    if found is None:
        p.error(f"no query {a.query}")
    df = found(spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.format(a.format).mode("overwrite").save(a.out)
    else:
        df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
