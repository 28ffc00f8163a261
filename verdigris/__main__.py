"""python -m verdigris COMMAND: thin commands over the library."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="verdigris")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="verdict of two result tables")
    c.add_argument("base")
    c.add_argument("candidate")
    c.add_argument("--resamples", type=int, default=10_000)
    c.add_argument("--seed", type=int, default=20260930)
    s = sub.add_parser("summary", help="mean task success of a result table")
    s.add_argument("results")
    k = sub.add_parser("check", help="violations of a task file against a corpus")
    k.add_argument("tasks")
    k.add_argument("corpus")
    k.add_argument("--sizes", default="")
    b = sub.add_parser("build", help="render a seed as markdown documents")
    b.add_argument("seed")
    b.add_argument("folder")
    w = sub.add_parser("power", help="block rates by true difference")
    w.add_argument("--sd", type=float, default=0.45)
    w.add_argument("--n", type=int, default=300)
    w.add_argument("--trials", type=int, default=1000)
    q = sub.add_parser("query", help="one registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from verdigris.operators import quality
    from verdigris.operators import statistics as st
    from verdigris.plans import catalogue, gate
    from verdigris.sources import files, schemas

    spark = SparkSession.builder.appName("verdigris").getOrCreate()
    if a.command == "compare":
        out = gate.compare(files.read_results(spark, a.base), files.read_results(spark, a.candidate), a.resamples, a.seed)
        print(json.dumps(out))
        return gate.EXIT[out["verdict"]]
    if a.command == "summary":
        print(json.dumps(gate.run_summary(files.read_results(spark, a.results))))
    elif a.command == "check":
        bad = quality.check_tasks(files.load_tasks(spark, a.tasks), files.read_corpus(spark, a.corpus), schemas.parse_split_sizes(a.sizes)).cache()
        bad.show(50, truncate=False)
        return int(bad.count() > 0)
    elif a.command == "build":
        head, docs = files.read_seed(spark, a.seed)
        print(len(files.write_corpus(files.render_documents(docs, head["company"]), a.folder)), "documents")
    elif a.command == "power":
        st.power_table(st.simulated(spark, [-8, -7, -6, -5, 0], a.sd, a.n, a.trials)).orderBy("true_delta").show()
    else:
        catalogue.QUERIES[a.name](spark, a.folder).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
