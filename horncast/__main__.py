"""``python -m horncast check FILE...``: compiles theories; ``rules FILE``: prints their flat rules; ``run
FILE --load relation=path.parquet ... --out FOLDER``: closes a model over files of element ids; ``migrate
FILE``: prints a theory of the older surface in the current one, and fails if it had queries."""

from __future__ import annotations

import argparse
import sys

from .functions.legacy import translate
from .lang.errors import TheoryError
from .model import load_theory


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="horncast", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check", "rules", "migrate"):
        commands.add_parser(name).add_argument("files", nargs="+")
    run = commands.add_parser("run")
    run.add_argument("file")
    run.add_argument("--load", action="append", default=[], metavar="RELATION=PATH")
    run.add_argument("--out", required=True)
    run.add_argument("--max-rounds", type=int)
    args = parser.parse_args(argv)
    try:
        if args.command == "run":
            from pyspark.sql import SparkSession

            theory = load_theory(args.file)
            spark = SparkSession.builder.getOrCreate()
            model = theory.model(spark)
            for item in args.load:
                relation, _, path = item.partition("=")
                model.load(relation, spark.read.parquet(path))
            model.close(max_rounds=args.max_rounds)
            for relation in theory.compiled.relations:
                model.table(relation).write.mode("overwrite").parquet(f"{args.out}/{relation}.parquet")
            return 0
        if args.command == "migrate":
            left_out = []
            for file in args.files:
                with open(file, encoding="utf-8") as f:
                    done = translate(f.read())
                print(done.source, end="")
                left_out += done.left_out
            if left_out:
                print(f"queries have no counterpart: {', '.join(left_out)}", file=sys.stderr)
            return int(bool(left_out))
        for file in args.files:
            compiled = load_theory(file).compiled
            print(f"{file}: {len(compiled.relations)} relations, {len(compiled.rules)} flat rules")
            if args.command == "rules":
                for r in compiled.rules:
                    print(f"  {r.name}: {[(a.relation, a.vars) for a in r.premise]} => {r.insert or r.equal or ('define', r.define)}")
    except TheoryError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
