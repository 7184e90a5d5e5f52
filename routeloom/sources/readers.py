"""Readers of the engine's inputs. All take paths that Spark reads, and schemas instead of inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import first_block
from ..session import let_workers_import
from .archive import RuleArchive


def rules_path(root: str, database: str, radius: int, fp_size: int = 1024, folded: bool = True, custom: bool = False) -> str:
    """The folder of a rule set, by its parameters."""
    return f"{root}/database={database}/radius={radius}/fp_size={fp_size}/folded={str(folded).lower()}/custom={str(custom).lower()}"


def archived_rules(spark: SparkSession, npz: str, table: str, rows: int = 5000, trusted: bool = False) -> DataFrame:
    """A table (rules, need or delta) of a dense archive of rule arrays; each task reads a range of rows."""
    let_workers_import(spark)
    spark.dataSource.register(RuleArchive)
    return spark.read.format("rule_archive").option("path", npz).option("table", table).option("rows", rows).option("trusted", str(trusted)).load()


def convert_rules(spark: SparkSession, npz: str, out: str, rows: int = 5000, trusted: bool = False) -> None:
    """One-off: a dense archive of rule arrays to Parquet tables rules, need and delta.

    Text that is stored as Python objects is only read from a ``trusted`` archive, as that runs code from it.
    """
    for table in ("rules", "need", "delta"):
        archived_rules(spark, npz, table, rows, trusted).write.mode("append").parquet(f"{out}/{table}")


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, need, delta); a missing table is an error of the reader."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("rules", "need", "delta"))


def select_rules(tables: tuple[DataFrame, ...], keep: DataFrame) -> tuple[DataFrame, ...]:
    """All tables of a rule set for the rules in ``keep`` (rule_idx), in step."""
    return tuple(t.join(keep.select("rule_idx").distinct(), "rule_idx", "left_semi") for t in tables)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of text files with the file's own line numbers; several files count on in the order of their names.

    The lines of each split are counted where they are read, and a running sum over the splits (a row
    each) shifts them, so no task sees more than its split.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.option("lineSep", "\n").text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"))
    line = F.col("at") - F.col("first") + F.col("before") + 1
    return rows.join(splits, ["file", "start"]).select(line.alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """(place, name, mol, inchi) of available molecules: a CSV with an InChI column, or lines ``name<TAB>mol`` or ``mol``.

    Blank lines and comments are skipped.
    """
    said = (F.trim("value") != "") & ~F.col("value").startswith("#")
    lines, head = numbered_lines(spark, path).where(said), spark.read.text(path).where(said).first()
    if head is not None and "InChI" in head["value"].split(","):
        rows = spark.read.option("header", True).option("quote", '"').csv(path)
        return rows.select(F.monotonically_increasing_id().alias("place"), F.col("Name").alias("name"), F.lit(None).cast("string").alias("mol"), F.col("InChI").alias("inchi"))
    parts = F.split("value", "\t", 2)
    named = F.size(parts) == 2
    return lines.select(
        F.col("line").cast("long").alias("place"), F.when(named, F.trim(parts[0])).alias("name"), F.trim(F.when(named, F.get(parts, F.lit(1))).otherwise(parts[0])).alias("mol"),
        F.lit(None).cast("string").alias("inchi"),
    )


def keys_of(rows: DataFrame, column: str) -> DataFrame:
    """(key): distinct connectivity blocks of hashed identifiers."""
    return rows.select(first_block(F.col(column)).alias("key")).where("key is not null").distinct()


def read_cofactors(spark: SparkSession, path: str) -> DataFrame:
    """(key, name): the key prefix where given, else the block of the longer identifier."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    prefix = F.nullif(F.trim(F.coalesce("INCHIKEY_PREFIX", F.lit(""))), F.lit(""))
    return rows.select(F.coalesce(prefix, F.nullif(F.col("INCHI_PREFIX"), F.lit(""))).alias("key"), F.col("NAME").alias("name")).where("key is not null").distinct()


def read_tsv(spark: SparkSession, path: str, ddl: str, header: bool = False) -> DataFrame:
    return spark.read.schema(ddl).option("sep", "\t").option("header", header).option("comment", "#").option("quote", "").csv(path)


def read_names(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(id, name) of the wanted ids from a wide table; only two columns are kept of the scan."""
    return read_tsv(spark, path, S.COMPOUND).select("id", "name").join(wanted.select("id").distinct(), "id", "left_semi")


def read_reactions(spark: SparkSession, path: str) -> DataFrame:
    """(id, ec_numbers) of the reaction table."""
    return spark.read.option("header", True).option("sep", "\t").csv(path).select("id", "ec_numbers")


def read_equations(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    rows = read_tsv(spark, path, S.EQUATION).where(F.col("equation").contains("="))
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def read_compounds(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    return read_tsv(spark, path, S.COMPOUND).select("id", "name", "inchikey", "smiles").join(wanted.select("id").distinct(), "id", "left_semi")


def read_pathways(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files: name and variant come from the file's place; a file without exactly one source is an error.

    A field that holds a list or a single value becomes a list.
    """
    files = spark.read.schema(S.PATHWAY).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+\.json$", 1)
    files = files.select(folder.alias("pathway"), F.regexp_replace(stem, r"^.*_", "").alias("variant"), "elements")
    sources = F.size(F.filter("elements.nodes", lambda n: F.lower(F.coalesce(n["data"]["isSource"], F.lit("false"))) == "true"))
    checked = F.when(sources == 1, F.col("elements.nodes")).otherwise(F.raise_error(F.lit("a pathway needs exactly one source")))
    as_list = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$", "string"))))
    nodes = files.select("pathway", "variant", F.explode(checked).alias("n")).select("pathway", "variant", "n.data.*")
    nodes = nodes.select(
        "pathway", "variant", "id", "type", F.col("SMILES").alias("mol"), (F.lower("inSink") == "true").alias("in_sink"), (F.lower("isSource") == "true").alias("is_source"),
        as_list(F.col("Rule ID")).alias("rules"), as_list(F.col("EC number")).alias("ec"), F.col("Diameter").try_cast("int").alias("diameter"),
    )
    edges = files.select("pathway", "variant", F.explode("elements.edges").alias("e")).select("pathway", "variant", "e.data.*")
    return nodes, edges


def steps_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pathway, reaction, substrate, precursors, diameter): a row per reaction."""
    key = ["pathway", "variant"]
    compounds = nodes.where("type = 'compound'").select(*key, "id", "mol")
    reactions = nodes.where("type = 'reaction'").select(*key, F.col("id").alias("reaction"), "diameter")
    into = edges.withColumnRenamed("source", "id").withColumnRenamed("target", "reaction").join(compounds, [*key, "id"])
    made = edges.withColumnRenamed("source", "reaction").withColumnRenamed("target", "id").join(compounds, [*key, "id"])
    up = into.groupBy(*key, "reaction").agg(F.min("mol").alias("substrate"))
    down = made.groupBy(*key, "reaction").agg(F.array_sort(F.collect_list("mol")).alias("precursors"))
    return reactions.join(up, [*key, "reaction"]).join(down, [*key, "reaction"])


def step_pairs(steps: DataFrame, key=lambda c: c) -> DataFrame:
    """(pathway, substrate, precursor): a row per pair, without those of equal keys. Not the grain of ``steps_of``."""
    flat = steps.select("pathway", "substrate", F.explode("precursors").alias("precursor"))
    return flat.where(key(F.col("substrate")) != key(F.col("precursor")))


def read_targets(spark: SparkSession, path: str, key=lambda c: c) -> DataFrame:
    """(name, mol, raw, line): listed targets in order, without repeats by key; unnamed ones are ``target{line}``."""
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t", 2)
    named = F.size(parts) == 2
    raw = F.trim(F.when(named, F.get(parts, F.lit(1))).otherwise(parts[0]))
    name = F.when(named, F.replace(F.trim(parts[0]), F.lit(" "), F.lit("_"))).otherwise(F.format_string("target%d", "line"))
    rows = lines.select("line", name.alias("name"), raw.alias("raw"), key(raw).alias("mol")).where("mol is not null and mol <> ''")
    first = F.row_number().over(Window.partitionBy("mol").orderBy("line"))
    return rows.withColumn("n", first).where("n = 1").select("name", "mol", "raw", "line")


def read_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Run tables (tab-separated, any number of files) with their ``source``; empty fields are null, ``nan`` is NaN.

    Headers that a torn file repeats and rows without a policy are skipped. A lacking column is an error.
    """
    names = [x.split()[0] for x in S.RUN.split(", ")]
    text = spark.read.option("header", True).option("sep", "\t").option("mode", "PERMISSIVE").csv(paths).withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    optional = {"llm_calls", "llm_input_tokens", "llm_output_tokens", "llm_fallbacks"}
    missing = [n for n in names if n not in text.columns and n not in optional]
    if missing:
        raise ValueError(f"the run table lacks {missing}")
    rows = text.where("policy is not null and policy <> '' and policy <> 'policy'")
    kinds = dict(x.split() for x in S.RUN.split(", "))
    column = lambda n: F.coalesce(F.col(n).try_cast(kinds[n]), F.lit(0)) if n in optional and n in text.columns else F.lit(0).cast(kinds[n]) if n in optional else F.col(n).try_cast(kinds[n])
    return rows.select(*(column(n).alias(n) for n in names), "source")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PAIR).json(path)

