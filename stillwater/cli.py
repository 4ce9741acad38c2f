"""python -m stillwater.cli -f MODEL: the long-run distribution of a model, a line for each state."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from stillwater.operators import rates, states
from stillwater.plans.solver import Solver
from stillwater.sources.models import read_model


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stillwater", description="Long-run distribution of an asynchronous Boolean network.")
    p.add_argument("-f", "--bnet-file", required=True, help="the model, a line 'node, rule' for each node")
    p.add_argument("-t", "--trans-distribution", choices=["NORMAL", "UNIFORM"], default="UNIFORM", type=str.upper, help="where rates that are not given come from")
    p.add_argument("--mean", type=float, default=0.0)
    p.add_argument("--std", type=float, default=1.0)
    p.add_argument("--trans-rates", default="", help="rates as u_NAME=VALUE (up) and d_NAME=VALUE (down), comma-joined")
    p.add_argument("-i", "--initial-distribution", choices=["RANDOM", "UNIFORM"], default="UNIFORM", type=str.upper)
    p.add_argument("--initial-fixed-prob", type=float, default=1.0, help="probability of the states that the fixed list allows")
    p.add_argument("--initial-fixed-list", default="", help="fixed nodes as NAME=0 or NAME=1, comma-joined")
    p.add_argument("-s", "--symbolic", action="store_true", help="store results beside the model, and reuse them")
    p.add_argument("-n", "--no-symb-rates", action="store_true", help="accepted; stored results never hold factorisations")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> Solver:
    if args.initial_distribution == "RANDOM":
        raise NotImplementedError("random initial distributions")
    model = read_model(args.bnet_file, spark if "://" in args.bnet_file else None)
    up, down = rates.parse_overrides(args.trans_rates)
    chosen = rates.normal(model, args.mean, args.std, up, down) if args.trans_distribution == "NORMAL" else rates.uniform(model, up, down)
    fixed = states.parse_fixed(args.initial_fixed_list)
    initial = states.fixed(spark, model, fixed, args.initial_fixed_prob) if fixed else states.uniform(spark, model)
    place = (args.bnet_file.removesuffix(".bnet") if "://" in args.bnet_file else str(Path(args.bnet_file).resolve().with_suffix(""))) + ".stored" if args.symbolic else None
    return Solver(spark, model, chosen, initial, store_at=place)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("stillwater").getOrCreate()
    for row in run(spark, args).named().toLocalIterator():
        print(f"{row['nodes']} {row['p']:.8g}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
