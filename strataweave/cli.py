"""The command line: ``generate`` and ``update`` pages, and the ``status`` of providers and how to ``auth``enticate with them."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .functions.text import glob_regex
from .plans import pipeline, render
from .plans.enrich import CONCURRENCY, PROVIDERS, Generator, HttpGenerator, OfflineGenerator, providers
from .sources.files import BY_NAME

SOURCE, OUTPUT, SNAPSHOT = "force-app/main/default", "docs", ".strataweave"


def _at_least(least: int) -> object:
    def whole(text: str) -> int:
        if not text.isdigit() or int(text) < least:
            raise argparse.ArgumentTypeError(f"{text!r} is no whole number of {least} or more")
        return int(text)

    return whole


def _kinds(text: str) -> list[str]:
    found = [k.strip() for k in text.split(",") if k.strip()]
    if unknown := sorted(set(found) - set(BY_NAME)):
        raise argparse.ArgumentTypeError(f"unknown kinds {', '.join(unknown)}; there are {', '.join(BY_NAME)}")
    return found


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split(",") if w.strip()]


def _pattern(text: str) -> str:
    try:
        glob_regex(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None
    return text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strataweave", description="Reference pages from a tree of source and configuration files.")
    commands = out.add_subparsers(dest="command", required=True)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("--source-dir", default=SOURCE, help="the tree to read")
    both.add_argument("-o", "--output", default=OUTPUT, help="where pages go")
    both.add_argument("--snapshot", default=SNAPSHOT, help="where descriptions are kept")
    both.add_argument("--provider", default="offline", choices=["offline", *(p[0] for p in PROVIDERS)], help="who writes descriptions; all but offline send source text to a third party")
    both.add_argument("--model", help="the provider's model, if not its default")
    both.add_argument("-v", "--verbose", action="store_true", help="say what is done on standard error")
    make = commands.add_parser("generate", parents=[both], help="describe what is new or changed and write all pages")
    make.add_argument("--concurrency", type=_at_least(1), default=CONCURRENCY, help="calls at once")
    make.add_argument("--rpm", type=_at_least(0), default=0, help="calls a minute, 0 for no limit")
    make.add_argument("--force", action="store_true", help="describe everything anew")
    make.add_argument("--type", type=_kinds, action="extend", default=[], help="kinds, separated by commas")
    make.add_argument("--name-filter", type=_pattern, help="a shell pattern for names")
    make.add_argument("--tag", type=_words, action="extend", default=[], help="tags, separated by commas, of which classes and triggers must have one")
    one = commands.add_parser("update", parents=[both], help="describe one file anew and write its page and the index")
    one.add_argument("target", help="a path or a name")
    commands.add_parser("status", help="providers, their models and where their keys come from")
    sign = commands.add_parser("auth", help="how to give a provider's key")
    sign.add_argument("--provider", default=PROVIDERS[0][0], choices=[p[0] for p in PROVIDERS])
    return out


def generator(provider: str, model: str | None) -> tuple[Generator, str]:
    """The generator of a provider and the model that its descriptions are filed under."""
    if provider == "offline":
        return OfflineGenerator(), model or "offline"
    model = model or next(p[5] for p in PROVIDERS if p[0] == provider)
    return HttpGenerator(provider, model), model


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 0 if it went well, 1 with a message on standard error if not, 2 for wrong arguments."""
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO if getattr(a, "verbose", False) else logging.WARNING, stream=sys.stderr, format="%(message)s")
    if a.command == "auth":
        p = next(p for p in PROVIDERS if p[0] == a.provider)
        print(f"{p[1]} needs no key." if not p[3] else f"Set {p[2]} in the environment; keys are not stored.")
        return 0
    spark = spark or SparkSession.builder.appName("strataweave").getOrCreate()
    if a.command == "status":
        for r in providers(spark).collect():
            print(f"{r.provider:<8} {r.display_name:<16} {r.default_model:<26} {r.env_var:<16} {r.key_state}")
        return 0
    try:
        writer, model = generator(a.provider, a.model)
        if a.command == "generate":
            filters = pipeline.Filters(a.type, a.name_filter, a.tag)
            result = pipeline.build(spark, a.source_dir, a.snapshot, writer, model, filters, a.force, concurrency=a.concurrency, per_minute=a.rpm)
        else:
            result = pipeline.update(spark, a.target, a.source_dir, a.snapshot, writer, model)
        render.write_pages(result.pages, a.output)
    except (pipeline.NoFiles, pipeline.Failed, LookupError, OSError, ValueError) as e:
        print(f"strataweave: {e}", file=sys.stderr)
        return 1
    for kind, n in result.kinds.items():
        print(f"{kind}: {n['files']} files, {n['up_to_date']} up to date, {n['made']} described, {n['failed']} failed")
    print(", ".join(f"{n} {what.replace('_', ' ')}" for what, n in result.summary.items()))
    return 0
