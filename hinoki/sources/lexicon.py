"""Lexicon CSV, connection matrix, character definition, unknown-word and rewrite rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charclass import BITS

CSV_COLUMNS = ("headword", "left_id", "right_id", "cost", "surface", "pos1", "pos2", "pos3", "pos4", "pos5", "pos6", "reading", "normalized", "dict_form_ref", "unit_type", "a_split_ref", "b_split_ref", "structure_ref", "synonym_ref")
CSV_SCHEMA = ", ".join(f"{c} {'int' if c in ('left_id', 'right_id', 'cost') else 'string'}" for c in CSV_COLUMNS)
MAX_STRING, MAX_LIST = 32767, 127

# Particles that are joined by default, all with ids 0/0 and cost 1200.
COMPOUND_PARTICLES = {"終助詞": ("かも", "のか", "かな", "のかな", "かしら", "のかしら"), "接続助詞": ("のに", "ても", "でも", "とも"), "格助詞": ("とは",)}
COMPOUND_CONJUNCTIONS = ("だから",)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of lexicon CSV files with ``seq``, their 0-based line order over the given files."""
    paths = [path] if isinstance(path, str) else path
    out = None
    for i, p in enumerate(paths):
        df = spark.read.csv(p, schema=CSV_SCHEMA, quote='"', escape='"', multiLine=True, mode="FAILFAST", ignoreLeadingWhiteSpace=False)
        # One file is one multi-line split, so ids within it follow its lines.
        df = df.withColumn("seq", F.lit(i << 33) + F.monotonically_increasing_id())
        out = df if out is None else out.unionByName(df)
    return out


def unescape(c: Column) -> Column:
    r"""``\uXXXX`` and ``\u{X...}`` literals become their characters."""
    code = F.regexp_extract_all(c, F.lit(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))"), F.lit(0))
    hexes = F.transform(code, lambda x: F.regexp_replace(x, r"[\\u{}]", ""))
    char = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    return F.when(c.contains("\\u"), F.aggregate(F.arrays_zip(code.alias("k"), hexes.alias("h")), c, lambda acc, x: F.replace(acc, x["k"], char(x["h"])))).otherwise(c)


def synonyms(c: Column) -> Column:
    """``*`` or ``/``-separated integers."""
    return F.when(c.isNull() | (c == "*"), F.array().cast("array<int>")).otherwise(F.transform(F.split(c, "/"), lambda x: x.cast("int")))


def parse_rows(raw: DataFrame, dict_id: int = 0) -> DataFrame:
    """Typed lexicon rows; invalid rows raise an error that names the line."""
    texts = [c for c in CSV_COLUMNS if c not in ("left_id", "right_id", "cost")]
    df = raw.select(*[(unescape(F.col(c)).alias(c) if c in texts else F.col(c)) for c in CSV_COLUMNS], "seq")
    bad = (
        F.when(F.col("structure_ref").isNull(), "too few columns")
        .when(F.coalesce(F.length("headword"), F.lit(0)) == 0, "empty headword")
        .when(F.greatest(*[F.coalesce(F.octet_length(c), F.lit(0)) for c in ("headword", "surface", "reading", "normalized")]) > MAX_STRING, "string is too long")
        .when((F.col("unit_type") == "A") & ((F.col("a_split_ref") != "*") | (F.col("b_split_ref") != "*")), "unit A with splits")
        .when(F.size(synonyms(F.col("synonym_ref"))) > MAX_LIST, "too many synonyms")
    )
    df = df.withColumn("headword", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(" at line "), F.col("seq") + 1))).otherwise(F.col("headword")))
    return df.select(
        F.lit(dict_id).alias("dict_id"),
        F.col("seq").cast("int").alias("word_id"),
        F.when(F.col("left_id") != -1, F.col("headword")).alias("headword"),
        "left_id",
        "right_id",
        "cost",
        "surface",
        F.octet_length("headword").alias("headword_bytes"),
        F.length("headword").alias("headword_chars"),
        F.array(*[f"pos{i}" for i in range(1, 7)]).alias("pos"),
        F.coalesce(F.nullif(F.col("reading"), F.lit("")), F.col("surface")).alias("reading"),
        F.coalesce(F.nullif(F.col("normalized"), F.lit("")), F.col("surface")).alias("normalized"),
        "dict_form_ref",
        "unit_type",
        "a_split_ref",
        "b_split_ref",
        "structure_ref",
        synonyms(F.col("synonym_ref")).alias("synonym_gids"),
    )


def compound_particles(spark: SparkSession, dict_id: int = 1) -> DataFrame:
    """The default compound lexicon as parsed rows."""
    rows = [(w, ("助詞", kind, "*", "*", "*", "*")) for kind, words in COMPOUND_PARTICLES.items() for w in words]
    rows += [(w, ("接続詞", "*", "*", "*", "*", "*")) for w in COMPOUND_CONJUNCTIONS]
    raw = [(w, 0, 0, 1200, w, *pos, w, w, "*", "A", "*", "*", "*", "*", i) for i, (w, pos) in enumerate(rows)]
    return parse_rows(spark.createDataFrame(raw, CSV_SCHEMA + ", seq long"), dict_id)


def parse_matrix(lines: DataFrame) -> DataFrame:
    """(left, right, cost) of the lines (columns ``value`` and, if known, ``seq``) of a matrix file.

    The first line that isn't blank is the header, two numbers of ids; without ``seq``
    it is the only line of two numbers. Missing cells cost 0. A missing or second header,
    a line of another form and an id outside of the header's numbers are errors.
    """
    cols = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").select(cols.alias("c"), (F.col("seq") if "seq" in lines.columns else F.lit(0)).alias("seq"))
    heads = rows.filter(F.size("c") == 2).agg(F.count("*").alias("heads"), F.min(F.struct("seq", "c")).alias("h"))
    # One row: the sizes, the number of headers, and where they and the other lines begin.
    first = rows.filter(F.size("c") != 2).agg(F.min("seq").alias("first"))
    head = heads.crossJoin(first).select("heads", "first", F.col("h.seq").alias("at"), F.col("h.c")[0].try_cast("int").alias("nl"), F.col("h.c")[1].try_cast("int").alias("nr"))
    cells = rows.filter(F.size("c") != 2).select(F.size("c").alias("n"), *[F.try_element_at("c", F.lit(i + 1)).try_cast("int").alias(n) for i, n in enumerate(("left", "right", "cost"))])
    joined = F.broadcast(head).join(cells, F.lit(True), "left")
    no_head = (F.col("heads") != 1) | F.col("nl").isNull() | F.col("nr").isNull() | (F.col("at") > F.col("first"))
    inside = F.col("left").between(0, F.col("nl") - 1) & F.col("right").between(0, F.col("nr") - 1) & F.col("cost").between(-32768, 32767)
    bad = F.when(no_head, "a matrix begins with one line of two numbers").when(F.col("n").isNotNull() & ~((F.col("n") == 3) & F.coalesce(inside, F.lit(False))), "invalid matrix line")
    checked = joined.withColumn("ok", F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.col("n").isNotNull()))
    return checked.filter("ok").select("left", "right", "cost")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    # Ids follow the lines, as those of a file's later splits are larger.
    return parse_matrix(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()))


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small definition file, from wherever Spark can read."""
    return [r["value"] for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()


def parse_unknown_rules(lines: list[str]) -> list[tuple[str, int, int, int, tuple[str, ...]]]:
    """(category, left, right, cost, pos) of an unknown-word file."""
    out = []
    for number, line in enumerate(lines, 1):
        if not line.strip() or line.startswith("#"):
            continue
        cols = line.split(",")
        if len(cols) < 10 or cols[0] not in BITS:
            raise ValueError(f"invalid unknown-word rule at line {number}")
        out.append((cols[0], int(cols[1]), int(cols[2]), int(cols[3]), tuple(cols[4:10])))
    return out
