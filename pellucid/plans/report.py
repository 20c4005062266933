"""Findings as CSV rows and as a page of HTML."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.ordering import natural_key
from ..operators import findings
from ..operators.graph import cut, shared_dir
from ..sources.stores import store
from .analysis import Analysis

HEADER = "finding,file,group,detail"
#: Bytes of a report that the driver copies at a time.
PIECE = 1 << 20


def finding_rows(analysis: Analysis, keepers: DataFrame | None = None) -> DataFrame:
    """(section, number, member_rank, natural, finding, file, group, detail, byte_size): a row for each file and reason."""
    spark = analysis.records.sparkSession
    keepers = keepers if keepers is not None else spark.createDataFrame([], "group_id string, keeper string")
    path = F.col("relative_path")
    head = [natural_key(path).alias("natural")]

    def rows(members: DataFrame, groups: DataFrame, section: int, finding: str, detail) -> DataFrame:
        named = members.join(groups.select("group_id", "number", "name", *(c for c in ("splits", "identical") if c in groups.columns)), "group_id")
        return named.select(F.lit(section).alias("section"), "number", "member_rank", *head, F.lit(finding).alias("finding"), path.alias("file"), F.col("name").alias("group"), detail.alias("detail"), "byte_size")

    bad = analysis.problems.select(
        F.lit(0).alias("section"), F.lit(0).alias("number"), F.lit(0).alias("member_rank"), *head, F.lit("Won't open").alias("finding"), path.alias("file"), F.lit("").alias("group"), findings.problem_summary(F.col("problem")).alias("detail"), "byte_size"
    )
    role = lambda other: F.when(F.col("is_keeper"), "keeping").otherwise(other)
    exact = rows(findings.chosen_keepers(analysis.exact_members, keepers), analysis.exact_groups, 1, "Exact duplicate", role("redundant copy"))
    groups, members = analysis.near
    near = rows(findings.chosen_keepers(members, keepers), groups, 2, "Near duplicate", F.concat(role("similar copy"), F.lit(", differs by "), F.col("spread"), F.lit(" of 64 bits")))
    groups, members = analysis.leakage
    leaks = rows(members, groups, 3, "Split leakage", F.concat("splits", F.lit(", "), F.when(F.col("identical"), "identical copy").otherwise("similar copy")))
    return bad.unionByName(exact).unionByName(near).unionByName(leaks)


def csv_field(value):
    """A field with quotes only if it needs them."""
    return F.when(value.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


ORDER = ("section", "number", "member_rank", "natural", "file")


def csv_lines(analysis: Analysis, keepers: DataFrame | None = None) -> DataFrame:
    """(line) in the report's order, without the header."""
    rows = finding_rows(analysis, keepers).orderBy(*ORDER)
    return rows.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in ("finding", "file", "group", "detail"))).alias("line"))


def byte_text(n: int) -> str:
    """Bytes in decimal units, as file managers show them."""
    if n < 1000:
        return f"{n} byte{'s' * (n != 1)}"
    size = float(n)
    for unit, places in (("kB", 0), ("MB", 1), ("GB", 2), ("TB", 2)):
        size /= 1000
        if size < 999.5 or unit == "TB":
            return f"{size:.{places}f}".rstrip("0").rstrip(".") + f" {unit}" if places else f"{size:.0f} {unit}"
    return str(n)


def byte_column(n: Column) -> Column:
    """byte_text of a column."""
    out = None
    for k, (unit, places) in reversed(list(enumerate((("kB", 0), ("MB", 1), ("GB", 2), ("TB", 2)), 1))):
        size = n / F.lit(1000.0**k)
        shown = F.regexp_replace(F.format_string(f"%.{places}f", F.bround(size, places)), r"(\.[0-9]*?)0+$", "$1")
        text = F.concat(F.regexp_replace(shown, r"\.$", ""), F.lit(f" {unit}"))
        out = text if out is None else F.when(size < 999.5, text).otherwise(out)
    return F.when(n == 1, F.lit("1 byte")).when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(out)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escaped(value: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(c), F.lit(name))
    return value


#: Sections of the page: title, note and columns; what a section's rows show follows in html_lines.
SECTIONS = (
    ("Won't open", "What is in them isn't a whole picture.", ("File", "Problem")),
    ("Exact duplicates", "Equal in every byte; one of each group is enough.", ("Files", "Group", "Recoverable")),
    ("Near duplicates", "Alike to the eye; look before removing any.", ("Files", "Group", "Recoverable")),
    ("Split leakage", "What a model is tested on, it should not have seen.", ("Files", "Splits", "Certainty")),
    ("Folder balance", "Images of each label.", ("Folder", "Images")),
)
LAST = (1 << 31) - 1


def html_lines(analysis: Analysis, keepers: DataFrame | None = None) -> DataFrame:
    """(line) of the page in order.  A line holds one file, so a group's row is as many lines as it has members, and nothing is gathered."""
    spark = analysis.records.sparkSession
    h = analysis.health.first()
    found = cut(finding_rows(analysis, keepers))
    groups = found.where("group <> ''").groupBy("section", "number").agg(F.max("member_rank").alias("last"), F.sum(F.when(F.col("detail").startswith("keeping"), F.lit(0)).otherwise(F.col("byte_size"))).alias("more"))
    rows = found.join(groups, ["section", "number"], "left")
    cell = lambda *x: F.concat(F.lit("</td><td>"), *x)
    file, detail = escaped(F.col("file")), escaped(F.col("detail"))
    both = F.concat(file, F.lit(" ("), detail, F.lit(")"))
    leak = F.split(detail, ", ")
    splits, certainty = F.array_join(F.slice(leak, 1, F.greatest(F.size(leak) - 1, F.lit(1))), ", "), F.element_at(leak, -1)
    opening = F.when((F.col("section") == 0) | (F.col("member_rank") == 1), F.lit("<tr><td>")).otherwise(F.lit("<br>"))
    shown = F.when(F.col("section") == 0, F.concat(file, cell(detail))).when(F.col("section") == 3, file).otherwise(both)
    more = F.when(F.col("section") == 3, F.concat(cell(splits), cell(certainty))).otherwise(F.concat(cell(escaped(F.col("group"))), cell(byte_column(F.col("more")))))
    closing = F.when(F.col("section") == 0, F.lit("</td></tr>")).when(F.col("member_rank") == F.col("last"), F.concat(more, F.lit("</td></tr>"))).otherwise(F.lit(""))
    rows = rows.select(*ORDER, F.concat(opening, shown, closing).alias("line"))
    filled = {r[0] for r in rows.select("section").distinct().collect()}  # four at most
    if h["has_labels"]:
        tally = findings.label_tally(analysis.records)
        filled.add(4)
        line = F.concat(F.lit("<tr><td>"), escaped(F.col("name")), cell(F.col("n").cast("string")), F.lit("</td></tr>"))
        rows = rows.unionByName(tally.select(F.lit(4).alias("section"), F.col("place").cast("int").alias("number"), F.lit(0).alias("member_rank"), natural_key(F.col("name")).alias("natural"), F.col("name").alias("file"), line.alias("line")))

    title = escape(analysis.root.rstrip("/").rpartition("/")[2])
    tiles = {"Images": h["n_images"], "Won't open": h["n_problems"], "Exact groups": h["n_exact_groups"], "Redundant copies": h["n_redundant"], "Recoverable": byte_text(h["reclaimable_bytes"]), "Near duplicates": h["n_near_images"], "Split leakage": h["n_leaks"]}
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>{h["n_images"]} images, {byte_text(h["n_bytes"])}, scanned {analysis.scanned_at:%Y-%m-%d %H:%M}</p>'
    frame = [(-1, 0, head + "<ul>" + "".join(f"<li>{escape(k)}: {escape(str(v))}</li>" for k, v in tiles.items()) + "</ul>")]
    for k, (name, note, columns) in enumerate(SECTIONS):
        opened = f"<h2>{escape(name)}</h2><p>{escape(note)}</p>"
        if k in filled:
            frame += [(k, -1, opened + "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + "</tr>"), (k, LAST, "</table>")]
        elif k < 4:
            frame.append((k, -1, opened + "<p>Nothing found.</p>"))
    frame.append((len(SECTIONS), 0, f"<p>Version {__version__}</p></body></html>"))
    edges = spark.createDataFrame(frame, "section int, number int, line string")
    edges = edges.select("section", "number", F.lit(0).alias("member_rank"), F.array().cast(rows.schema["natural"].dataType).alias("natural"), F.lit("").alias("file"), "line")
    return rows.unionByName(edges).orderBy(*ORDER).select("line")


def report_lines(path: str, analysis: Analysis, keepers: DataFrame | None = None) -> tuple[list[str], DataFrame]:
    """The lines before, and the (line) that follow: CSV for names that end in .csv, HTML for all others."""
    return ([HEADER], csv_lines(analysis, keepers)) if path.lower().endswith(".csv") else ([], html_lines(analysis, keepers))


def contents(path: str, analysis: Analysis, keepers: DataFrame | None = None) -> str:
    """The whole report as one text; export() writes large ones."""
    first, lines = report_lines(path, analysis, keepers)
    return "".join(f"{x}\n" for x in (*first, *(r["line"] for r in lines.toLocalIterator())))


def csv_text(analysis: Analysis, keepers: DataFrame | None = None) -> str:
    return contents("report.csv", analysis, keepers)


def html_text(analysis: Analysis, keepers: DataFrame | None = None) -> str:
    """One self-contained page."""
    return contents("report.html", analysis, keepers)


def export(path: str, analysis: Analysis, keepers: DataFrame | None = None) -> None:
    """Write the report, whole or not at all.

    Tasks write its lines, in ranges, to the shared folder; the ranges are copied behind one another into a
    new file, a piece at a time, which then takes the report's name at once.  So the driver holds a piece, however long the report is.
    """
    first, lines = report_lines(path, analysis, keepers)
    spark = analysis.records.sparkSession
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    lines.write.text(folder)
    source, at = store(folder)
    target, to = store(path)
    try:
        with target.open_output_stream(f"{to}.new") as out:
            out.write("".join(f"{x}\n" for x in first).encode())
            for f in sorted(source.get_file_info(pa.fs.FileSelector(at)), key=lambda f: f.base_name):
                if f.base_name.startswith("part-"):
                    with source.open_input_stream(f.path) as part:
                        while piece := part.read(PIECE):
                            out.write(piece)
        target.move(f"{to}.new", to)
    finally:
        source.delete_dir(at)
