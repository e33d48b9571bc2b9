"""Document tables from folders of files, and tolerant readers of stored JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import collapse_space, strip_space
from tessera.sources.store import Store
from tessera.sources.text_formats import EXTENSIONS, READERS, csv_cells, extension

PARSED = "filename string, text string, columns array<string>, cells array<array<string>>, source string, mtime double, error string"
#: Rows of a table without a text or name column that are rendered.
MOST_ROWS = 200
# Columns that decide how a CSV file is rendered, in order of preference.
NARRATIVE = ("full_text", "text", "content", "body", "article", "description")
NAMES = ("name", "title", "entity", "label", "term")
KINDS = ("type", "category", "kind", "class", "group")


def supported(path_column: str = "path"):
    return F.lower(F.regexp_extract(path_column, r"(\.[^./\\]+)$", 1)).isin(*EXTENSIONS)


def parse_files(files: DataFrame) -> DataFrame:
    """Documents of binary files ``path, modificationTime, content``; a file that fails gives a row with its error and no text.

    Python only takes files apart; CSV rows become text by expressions.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, mtime, content in zip(batch["path"], batch["mtime"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                text = columns = cells = error = None
                try:
                    if extension(name) == ".csv":
                        columns, cells = csv_cells(bytes(content))
                    else:
                        text = READERS[extension(name)](bytes(content)).strip()
                except Exception as e:  # one bad file must not end the job
                    error = f"{type(e).__name__}: {e}"
                rows.append((name, text, columns, cells, path, mtime, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    seconds = (F.unix_micros("modificationTime") / 1e6).alias("mtime")
    parsed = files.where(supported()).select("path", seconds, "content").mapInPandas(parse, PARSED)
    table, extra = csv_rendering(F.col("columns"), F.col("cells"))
    is_table = F.col("columns").isNotNull()
    none = F.when(F.col("error").isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return parsed.select("filename", F.when(is_table, table).otherwise(F.col("text")).alias("text"), "source", "mtime", F.when(is_table, extra).otherwise(none).alias("extra"), "error")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not again for every element of the arrays it is used with."""
    return F.element_at(F.transform(F.array(value), use), 1)


def csv_rendering(columns: Column, cells: Column, most: int = MOST_ROWS) -> tuple[Column, Column]:
    """Text and metadata of a CSV file given as its header and rows of cells, in which missing ones are null.

    The first of the text columns gives its cells; otherwise a name and a type column give a block per row that has a name;
    otherwise the first ``most`` rows are listed under a schema.  A file without rows gives an empty text.
    """
    lower = F.transform(columns, lambda c: F.lower(c))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position(lower, F.lit(n)), F.lit(0)) for n in names]).cast("int")
    text_at = place(NARRATIVE)
    numbers = F.transform(columns, lambda c, i: i + 1)
    n = F.size(cells)

    def kind(i: Column) -> Column:
        of = F.transform(cells, lambda r: F.element_at(r, i))
        all_are = lambda pattern: F.forall(of, lambda c: c.isNull() | c.rlike(pattern))
        whole, missing = all_are(r"^\s*[-+]?\d+\s*$"), F.exists(of, lambda c: c.isNull())
        number = all_are(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$")
        truth = all_are(r"^(?:True|False|TRUE|FALSE|true|false)$") & ~missing
        return F.when(whole & ~missing, "int64").when(number, "float64").when(truth, "bool").otherwise("object")

    def shown(cell: Column, kind: Column) -> Column:
        plain = collapse_space(F.coalesce(cell, F.lit("")))
        as_double = cell.try_cast("double").cast("string")
        real = F.when(cell.isNotNull() & ~F.contains(as_double, F.lit("E")), as_double).otherwise(plain)
        return F.when(kind == "float64", real).when(kind == "bool", F.initcap(plain)).otherwise(plain)

    pair = lambda row, i, form: F.format_string(form, F.element_at(columns, i), F.element_at(row, i))
    listed = lambda row, form, keep: F.transform(F.filter(numbers, lambda i: keep(i) & (F.element_at(row, i) != "")), lambda i: pair(row, i, form))
    narrative = F.array_join(F.transform(cells, lambda r: F.element_at(r, text_at)), "\n\n---\n\n")

    def block(row: Column, name_at: Column, kind_at: Column) -> Column:
        said = F.element_at(row, kind_at)
        head = F.array(F.concat(F.lit("## "), F.element_at(row, name_at)), F.concat(F.lit("- **Type:** "), F.when(said == "", "unspecified").otherwise(said)))
        return F.array_join(F.concat(head, listed(row, "- **%s:** %s", lambda i: (i != name_at) & (i != kind_at))), "\n")

    def named(rows: Column) -> Column:
        return _bound(place(NAMES), lambda n: _bound(place(KINDS), lambda k: F.array_join(F.transform(F.filter(rows, lambda r: F.element_at(r, n) != ""), lambda r: block(r, n, k)), "\n\n")))

    def table(rows: Column, kinds: Column) -> Column:
        lines = F.filter(F.transform(rows, lambda r: F.array_join(listed(r, "%s=%s", lambda i: F.lit(True)), "; ")), lambda x: x != "")
        schema = F.array_join(F.zip_with(columns, kinds, lambda c, k: F.concat(c, F.lit(" ("), k, F.lit(")"))), ", ")
        head = F.concat(F.lit("Schema: "), schema, F.lit("\n\nRows ("), F.least(F.lit(most), n).cast("string"), F.lit(" of "), n.cast("string"), F.lit("):\n"))
        return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))

    def rendered(kinds: Column) -> Column:
        rows = F.transform(F.when(mode == "table", F.slice(cells, 1, most)).otherwise(cells), lambda r: F.zip_with(r, kinds, shown))
        return _bound(rows, lambda rows: F.when(mode == "table", table(rows, kinds)).otherwise(named(rows)))

    by_name = place(NAMES).isNotNull() & place(KINDS).isNotNull()
    mode = F.when(n == 0, "empty").when(text_at.isNotNull(), "narrative").when(by_name, "entity_per_row").otherwise("table")
    text = F.when(mode == "empty", "").when(mode == "narrative", narrative).otherwise(_bound(F.transform(numbers, kind), rendered))
    meta = F.create_map(F.lit("row_count"), n.cast("string"), F.lit("csv_mode"), mode)
    cut = F.create_map(F.lit("truncated_to"), F.lit(str(most)))
    return strip_space(text), F.when((mode == "table") & (n > most), F.map_concat(meta, cut)).otherwise(meta)


def parse_topic(spark: SparkSession, folder: str, with_errors: bool = False) -> DataFrame:
    """The documents of a topic's folder, not of its subfolders; empty texts are dropped.

    Raises ``FileNotFoundError`` for a missing folder.  ``with_errors`` keeps the rows of files that failed.
    """
    if not Store(spark, folder).exists(""):
        raise FileNotFoundError(f"no folder for this topic: {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    docs = parse_files(files)
    has_text = F.coalesce(strip_space(F.col("text")) != "", F.lit(False))
    return docs.where(has_text | F.col("error").isNotNull()) if with_errors else docs.where(has_text).drop("error")


def html_fallback(html):
    """Visible text of HTML by expressions alone: dropped blocks out, tags to line ends, the usual entities decoded."""
    c = html
    for tag in ("script", "style", "nav", "footer", "header"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip_space(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"))


def tolerant_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row of a JSON file under a schema; nothing where it is missing or corrupt."""
    parsed = _schema(schema)
    if not Store(spark, path).exists(""):
        return spark.createDataFrame([], parsed)
    raw = spark.read.option("wholetext", True).text(path)
    good = raw.select(F.from_json("value", parsed, {"mode": "PERMISSIVE"}).alias("v"), F.expr("try_parse_json(value)").isNotNull().alias("ok"))
    return good.where("ok and v is not null").select("v.*")


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema
