"""Command-line tools: analyze, build-system, build-user, print-dict and print-header.

A dictionary is a folder of Parquet tables: ``rows`` as parsed, ``connection`` (system
dictionaries only) and ``meta`` with type, creation time and description. References are
resolved where dictionaries are put together, so a user dictionary has its rows alone.
"""

from __future__ import annotations

import argparse
import io
import json
import sys
import time
from collections.abc import Callable, Sequence
from csv import writer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..operators.tokenize import Engine
from ..sources import lexicon as src
from .config import Config, attribute, engine, find_file
from .dictionary import Dictionary

MODES = {"A": "A", "B": "B"}


# -- building ------------------------------------------------------------------------
def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def assembled(spark: SparkSession, system: str, users: Sequence[str] = (), compounds: bool = False) -> Dictionary:
    """A system dictionary, the default compounds if wanted, then user dictionaries in order."""
    rows = [read_rows(spark, system)]
    if compounds:
        rows.append(src.compound_particles(spark))
    return Dictionary.build(rows + [read_rows(spark, u) for u in users], spark.read.parquet(f"{system}/connection"))


def build(spark: SparkSession, out: str, files: Sequence[str], matrix: str | None = None, system: str | None = None, description: str = "", progress: Callable[[str, str, int | None], None] | None = None) -> dict:
    """Write a system (``matrix``) or user (``system``) dictionary; returns statistics.

    All references are resolved once before anything is written, so invalid rows and
    connections fail the build. ``inputs`` and ``outputs`` of the statistics hold name,
    milliseconds and entries of each. ``progress(part, name, entries)`` is called when a
    part begins (entries None) and when it ends.
    """
    tell = progress or (lambda part, name, entries: None)
    if (matrix is None) == (system is None):
        raise ValueError("either a matrix or a system dictionary")
    stats: dict = {"inputs": [], "outputs": []}

    def timed(kind: str, name: str, step: Callable[[], int]) -> None:
        tell(kind, name, None)
        began = time.perf_counter()
        entries = step()
        tell(kind, name, entries)
        stats[kind].append({"name": name, "time_ms": round((time.perf_counter() - began) * 1000, 2), "entries": entries})

    rows = src.parse_rows(src.read_csv(spark, list(files)))
    cells = src.read_matrix(spark, matrix) if matrix else spark.read.parquet(f"{system}/connection")
    whole = Dictionary.build([rows] if matrix else [read_rows(spark, system), rows], cells)
    for f in files:
        timed("inputs", f, src.parse_rows(src.read_csv(spark, f)).count)
    timed("inputs", "references", lambda: len(whole.compile().words))

    def write(name: str, df: DataFrame) -> None:
        def step() -> int:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
            return spark.read.parquet(f"{out}/{name}").count()

        timed("outputs", name, step)

    write("rows", rows)
    if matrix:
        write("connection", cells)
    write("meta", spark.createDataFrame([("system" if matrix else "user", int(time.time() * 1000), description)], "type string, create_time long, description string"))
    return stats


def rendered(stats: dict, kind: str) -> str:
    """Build statistics for a console, as JSON or as CSV."""
    if kind == "json":
        return json.dumps(stats, ensure_ascii=False, indent=2)
    if kind == "csv":
        text = io.StringIO()
        w = writer(text, lineterminator="\n")
        w.writerow(("part", "name", "time_ms", "entries"))
        w.writerows((part[:-1], s["name"], s["time_ms"], s["entries"]) for part in ("inputs", "outputs") for s in stats[part])
        return text.getvalue().rstrip("\n")
    lines = []
    for part in ("inputs", "outputs"):
        lines += [f"{part}:", *(f"  {s['name']}: {s['time_ms']:.2f} ms, {s['entries']} entries" for s in stats[part] or [])]
        lines.append(f"  total: {sum(s['time_ms'] for s in stats[part]):.2f} ms")
    return "\n".join(lines)


# -- printing ------------------------------------------------------------------------
def header(spark: SparkSession, path: str) -> list[str]:
    """File name, type, creation time (ISO, UTC) and description."""
    # Rendered in UTC, whatever the session's time zone.
    instant = F.to_utc_timestamp(F.timestamp_millis("create_time"), F.current_timezone())
    r = spark.read.parquet(f"{path}/meta").select("type", F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), "description").first()
    return [f"filename: {path}", f"type: {r['type']} dictionary", f"createTime: {r['at']}", f"description: {r['description']}"]


def printed(spark: SparkSession, path: str, system: str | None = None) -> DataFrame:
    """Lexicon lines of a dictionary, in id order; a user dictionary needs its system dictionary."""
    kind = spark.read.parquet(f"{path}/meta").first()["type"]
    if kind == "user" and system is None:
        raise ValueError("a user dictionary is printed with its system dictionary")
    d = assembled(spark, system, [path]) if kind == "user" else assembled(spark, path)
    return d.printed().filter(F.col("dict_id") == (1 if kind == "user" else 0)).orderBy("word_id").select("line")


# -- analysis ------------------------------------------------------------------------
def engine_from(spark: SparkSession, config: Config, resources: Sequence[str] = ()) -> Engine:
    """The engine that a configuration names; definition files are looked for under ``resources``."""
    place = lambda p: find_file(p, resources)
    system = config.string("systemDict")
    if not system:
        raise ValueError("no system dictionary")
    dictionary = assembled(spark, place(system), [place(u) for u in config.items("userDict")], config.flag("enableDefaultCompoundParticles", True))
    lines = {k: src.read_lines(spark, place(config.string(k))) if config.string(k) else None for k in ("charDef", "unkDef", "rewriteDef")}
    return engine(dictionary, config, lines["charDef"], lines["unkDef"], lines["rewriteDef"])


def formatter(name: str | None, details: bool, words: bool) -> Callable[[Column], Column]:
    """Morphemes to the text of a line, without its line end."""
    if name:
        return attribute(name)
    if words:
        return lambda ms: formats.wakati(ms, eos="")
    return lambda ms: formats.detailed(ms, details, eos="\nEOS")


def analyzed(lines: DataFrame, own: Engine, mode: str, show: Callable[[Column], Column], tolerant: bool = False, debug: bool = False) -> DataFrame:
    """(value, error) of each line that isn't empty, in one narrow pass (two with ``debug``)."""
    kept = lines.filter(F.col("value") != "").select("value")
    if debug:
        kept = own.dump_table(kept.withColumn("line", F.col("value")), "value")
        value = F.concat(F.col("dump"), F.lit("\n"), show(F.col("morphemes")))
    else:
        kept, value = kept.withColumn("line", F.col("value")), show(F.col("morphemes"))
    done = own.tokenize_table(kept, "line", mode, tolerant)
    return done.select(F.when(F.col("error").isNull(), value).alias("value"), "error")


def _analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    config = Config.parse(a.s) if a.s else Config()
    if a.r:
        config = config.with_fallback(Config.read(spark, a.r))
    if a.systemDict:
        config = Config(config.values | {"systemDict": a.systemDict})
    config = Config(config.values | {"userDict": config.items("userDict") + a.userDict})
    own = engine_from(spark, config, [a.p] if a.p else [])
    lines = spark.read.text(a.files) if a.files else spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "value string")
    words = a.t or a.ts
    out = analyzed(lines, own, MODES.get(a.m.upper(), "C"), formatter(a.format, a.a, words), a.f, a.d)
    end = " " if a.t and not a.ts and not a.format else "\n"
    if a.o:
        # A text that failed has no value; its message goes beside the texts.
        if a.f:
            out.filter(F.col("error").isNotNull()).select("error").write.mode("append").text(f"{a.o.rstrip('/')}.errors")
        out.filter(F.col("error").isNull()).select("value").write.mode("append").option("lineSep", end).text(a.o)
        return
    for r in out.toLocalIterator():
        if r["error"] is None:
            sys.stdout.write(r["value"] + end)
        else:
            print(r["error"], file=sys.stderr)


def _print_dict(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = printed(spark, a.file, a.s)
    if a.o:
        lines.write.mode("overwrite").text(a.o)
    else:
        for r in lines.toLocalIterator():
            print(r["line"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hinoki")
    tools = top.add_subparsers(dest="tool", required=True)
    p = tools.add_parser("analyze", help="analyse lines of files or of standard input")
    p.add_argument("-r", metavar="FILE", help="settings from a file")
    p.add_argument("-s", metavar="JSON", help="settings that come before those of -r")
    p.add_argument("-p", metavar="DIR", help="root of resources")
    p.add_argument("-m", metavar="MODE", default="C", help="A, B or C")
    p.add_argument("-o", metavar="DIR", help="append texts to this folder")
    p.add_argument("-t", action="store_true", help="words with spaces")
    p.add_argument("-ts", action="store_true", help="words with spaces, a line for each text")
    p.add_argument("-a", action="store_true", help="details")
    p.add_argument("-d", action="store_true", help="lattices as well")
    p.add_argument("-f", action="store_true", help="go on after errors")
    p.add_argument("--systemDict", metavar="DIR", help="system dictionary, before all settings")
    p.add_argument("--userDict", metavar="DIR", action="append", default=[], help="one more user dictionary")
    p.add_argument("--format", metavar="NAME", help="module:function from morphemes to a text column")
    p.add_argument("files", nargs="*")
    for name, flag in (("build-system", "-m"), ("build-user", "-s")):
        p = tools.add_parser(name)
        p.add_argument("-o", required=True)
        p.add_argument(flag, required=True)
        p.add_argument("-d", default="")
        p.add_argument("--stats", choices=("console", "json", "csv"))
        p.add_argument("files", nargs="+")
    p = tools.add_parser("print-dict")
    p.add_argument("-s")
    p.add_argument("-o")
    p.add_argument("file")
    tools.add_parser("print-header").add_argument("files", nargs="+")
    return top


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.tool == "analyze":
        _analyze(spark, a)
    elif a.tool == "print-dict":
        _print_dict(spark, a)
    elif a.tool == "print-header":
        print("\n\n".join("\n".join(header(spark, f)) for f in a.files))
    else:
        stats = build(spark, a.o, a.files, getattr(a, "m", None), getattr(a, "s", None), a.d)
        if a.stats:
            print(rendered(stats, a.stats))
