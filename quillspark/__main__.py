"""Command lines: python -m quillspark pairs|compare|overlap|fill|convert|register|verify|demo.

Models are Python functions named as ``module:function``; without one the deterministic
stand-ins answer and score.
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import os
import sys
import typing

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import candidates, formats
from quillspark.plans import compare, demo, options, pairs
from quillspark.sources import files


def named(name: str | None, default=None):
    """The function ``module:function``."""
    if not name or name == "stand-in":
        return default
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"not a module:function name: {name}")
    return getattr(importlib.import_module(module), function)


def echo(texts: pd.Series) -> pd.Series:
    """Stands in for a model: the prompt itself."""
    return texts


def _options(parser: argparse.ArgumentParser, kind: type) -> None:
    """An option for each field of an options class."""
    hints = typing.get_type_hints(kind)
    for f in dataclasses.fields(kind):
        default = f.default if f.default is not dataclasses.MISSING else f.default_factory()
        if hints[f.name] is bool:
            parser.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=default)
        elif f.name == "temperatures":
            parser.add_argument("--temperatures", default=",".join(map(str, default)))
        else:
            parser.add_argument(f"--{f.name}", type=type(default) if default is not None else str, default=default)


def _made(kind: type, args: argparse.Namespace):
    values = {f.name: getattr(args, f.name) for f in dataclasses.fields(kind)}
    if "temperatures" in values:
        values["temperatures"] = tuple(candidates.parse_temperatures(values["temperatures"]))
    return kind(**values)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pairs", help="questions to preference pairs, in stages that resume")
    _options(p, options.PairOptions)
    p = sub.add_parser("compare", help="answers of two models side by side")
    _options(p, options.CompareOptions)
    p.add_argument("--base_model")
    p.add_argument("--sft_model")
    p = sub.add_parser("overlap", help="lexical overlap of evaluation and training questions")
    p.add_argument("--eval_file", required=True)
    p.add_argument("--train_file", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("fill", help="missing answers from a completion service")
    _options(p, options.FillOptions)
    p.add_argument("--client", help="module:function in place of the provider")
    p.add_argument("--system", default="")
    p = sub.add_parser("convert", help="filled answers to a training file")
    p.add_argument("--input", required=True)
    p.add_argument("--out_dir", required=True)
    p.add_argument("--system")
    p = sub.add_parser("register", help="add the training file to a registry; present entries stay")
    p.add_argument("--path", required=True)
    p = sub.add_parser("verify", help="a smoke chat of four questions")
    p.add_argument("--model")
    p = sub.add_parser("demo", help="questions through all training stages")
    p.add_argument("--question", action="append", required=True)
    p.add_argument("--model")
    p.add_argument("--judge")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    match args.command:
        case "pairs":
            o = _made(options.PairOptions, args)
            return pairs.run(spark, o, named(o.sft_model, candidates.stand_in_answer), named(o.judge_model))
        case "compare":
            o = _made(options.CompareOptions, args)
            return compare.compare(spark, o, named(args.base_model, echo), named(args.sft_model, echo), named(o.rm_model))
        case "overlap":
            e = files.read_json_array(spark, args.eval_file, schemas.EVALUATION).select(F.col("id").alias("key"), F.col("question").alias("text"), "role")
            t = files.with_position(files.read_csv(spark, args.train_file, schemas.QUESTION)).select(F.col("source_row").alias("key"), F.col("question").alias("text"), "role")
            row = compare.audit_overlap(spark, e, t, args.out).first()
            print(f"{row.flagged} of {row.questions} questions flagged")
            return row
        case "fill":
            o = _made(options.FillOptions, args)
            client = named(args.client) or candidates.chat_client(o.provider, os.environ.get("LLM_API_KEY", "").strip(), args.system)
            return compare.fill(spark, o.input, o.out, o.out, client, o.limit)
        case "convert":
            return compare.convert(spark, args.input, args.out_dir, args.system)
        case "register":
            return compare.register(spark, args.path, formats.SFT_ENTRY)
        case "verify":
            return demo.smoke(spark, named(args.model, echo)).show(truncate=60)
        case "demo":
            rows = spark.createDataFrame([(q,) for q in args.question], "question string")
            model = named(args.model, lambda stage, prompt: stage.str.cat(prompt, sep=": "))
            judge = named(args.judge, lambda question, answer: answer.str.len() / 100.0)
            return demo.run(spark, rows, _typed2(model), _typed2(judge)).show(truncate=60)


def _typed2(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    return run


if __name__ == "__main__":
    main(sys.argv[1:])
