"""Command line: python -m skein.cli align|train|evaluate ..."""

from __future__ import annotations

import argparse

from skein.operators import model
from skein.operators.assign import STRATEGIES
from skein.plans.engine import Engine
from skein.plans.session import build_session
from skein.sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein")
    sub = top.add_subparsers(dest="command", required=True)
    align = sub.add_parser("align", help="align two knowledge bases")
    for flag in ("source", "target", "model", "output"):
        align.add_argument(f"--{flag}", required=True)
    align.add_argument("--gold")
    align.add_argument("--strategy", choices=sorted(STRATEGIES), default="best")
    for name in ("train", "evaluate"):
        cmd = sub.add_parser(name)
        cmd.add_argument("--model", required=True)
        cmd.add_argument("--data", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    engine = Engine(spark)
    if args.command == "align":
        done = engine.align_files(args.source, args.target, args.model, args.output, args.strategy, args.gold)
        if done.metrics is not None:
            done.metrics.show()
    elif args.command == "train":
        engine.train(readers.training_jsonl(spark, args.data), args.model)
    else:
        engine.evaluate(model.load(args.model), readers.training_jsonl(spark, args.data)).show()


if __name__ == "__main__":
    main()
