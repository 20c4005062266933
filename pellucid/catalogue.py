"""Every query of the engine by name, and the DuckDB SQL that gives the same rows.

Queries run over whole tables.  Documents stand for files: see
sources/documents.py, and REC below for the same relation in SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import completeness, fingerprint, layout, ordering
from .functions.vectors import cohesion_description, norm, normalized, suggested_clusters
from .operators import cache, compare, findings, vectors
from .operators import similarity as sim
from .operators.graph import cut
from .operators.ranking import ranked, ranked_within
from .operators.spread import spreads
from .operators.vector_index import most_similar
from .plans.analysis import Analysis
from .plans.report import csv_field, csv_lines, finding_rows
from .sources.documents import document_records
from .streaming.live import LiveFindings
from .streaming.watch import changes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NATURAL = "list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 6, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END)"

_PATH = """(CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 10 = 7 THEN 'val/' WHEN doc_id % 10 >= 8 THEN 'test/' ELSE 'train/' END)
  || lang || '/doc' || doc_id || (CASE WHEN doc_id % 7 = 0 THEN ' copy' WHEN doc_id % 11 = 0 THEN ' (1)' ELSE '' END) || '.txt'"""

REC = f"""
r0 AS MATERIALIZED (SELECT *, {_PATH} AS relative_path,
  CASE WHEN length(text) = 0 THEN 'empty' WHEN doc_id % 97 = 0 THEN 'unreadable' WHEN doc_id % 89 = 0 THEN 'decode_failed' WHEN n_chars < 20 THEN 'truncated' END AS problem,
  list_transform(range(72), lambda i: unicode(substr(sig, CAST(1 + i AS BIGINT), 1))) AS gray,
  CASE WHEN doc_id % 29 = 0 THEN list_transform(range(48), lambda i: 255) ELSE list_transform(range(48), lambda i: unicode(substr(sig, CAST(25 + i AS BIGINT), 1))) END AS rgb
  FROM (SELECT *, CASE length(text) % 8 WHEN 1 THEN sig0[1:10] || 'z' || sig0[12:96] WHEN 2 THEN sig0[1:19] || 'zazaza' || sig0[26:96] ELSE sig0 END AS sig
    FROM (SELECT *, md5(k) || md5(k || '1') || md5(k || '2') AS sig0 FROM (SELECT *, CASE WHEN length(text) % 8 < 3 THEN 'L' || length(text) // 8 ELSE md5(text) END AS k FROM documents)))),
r1 AS MATERIALIZED (SELECT *, list_sum(list_transform(range(64), lambda k: CASE WHEN gray[(k // 8) * 9 + k % 8 + 1] > gray[(k // 8) * 9 + k % 8 + 2] THEN CAST(1 AS HUGEINT) << CAST(k AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS wide FROM r0),
rec AS MATERIALIZED (SELECT doc_id, 'file:///data/' || relative_path AS url, relative_path, CAST(strlen(text) AS BIGINT) AS byte_size,
  CASE WHEN doc_id % 19 <> 0 THEN CAST(1700000000 + doc_id * 3600 % 1000000 AS BIGINT) END AS modified_s,
  CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'PNG' ELSE 'JPEG' END END AS format,
  CASE WHEN doc_id % 17 <> 0 THEN n_chars % 640 + 1 END AS width, CASE WHEN doc_id % 17 <> 0 THEN n_chars % 480 + 1 END AS height,
  sha256(text) AS content_hash,
  CASE WHEN problem IS NULL THEN CAST(CASE WHEN wide >= CAST(9223372036854775808 AS HUGEINT) THEN wide - CAST(18446744073709551616 AS HUGEINT) ELSE wide END AS BIGINT) END AS bits,
  CASE WHEN problem IS NULL AND doc_id % 23 <> 0 THEN list_transform(rgb, lambda x: least(x, 255) >> 1) END AS color,
  problem, lang AS label,
  CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 10 = 7 THEN 'validation' WHEN doc_id % 10 >= 8 THEN 'test' ELSE 'train' END AS split,
  {NATURAL.format("relative_path")} AS nat,
  (doc_id % 7 = 0 OR doc_id % 11 = 0) AS is_copy, len(string_split(relative_path, '/')) AS depth FROM r1)"""

_APART = "bit_count(xor(a.bits, b.bits))"
_COLORS = "(list_sum(list_transform(list_zip(a.color, b.color), lambda x: abs(CAST(x[1] AS INTEGER) - CAST(x[2] AS INTEGER)))) // 48 <= 12)"
_KEEPER = "is_copy, depth, nat, relative_path"
_FIDELITY = "coalesce(width * height, 0) DESC, byte_size DESC, nat, relative_path"

#: Exact groups and representatives in SQL.
EXACT = f"""
exm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {_KEEPER}) AS member_rank, count(*) OVER (PARTITION BY content_hash) AS n_members FROM rec WHERE problem IS NULL),
ex AS (SELECT content_hash, 'exact-' || content_hash AS group_id, count(*) AS n_members, sum(CASE WHEN member_rank > 1 THEN byte_size ELSE 0 END) AS reclaimable_bytes, max(CASE WHEN member_rank = 1 THEN relative_path END) AS first_path FROM exm WHERE n_members > 1 GROUP BY content_hash),
exn AS (SELECT *, row_number() OVER (ORDER BY reclaimable_bytes DESC, {NATURAL.format("first_path")}, first_path) AS number FROM ex),
rep AS MATERIALIZED (SELECT * FROM exm WHERE member_rank = 1)"""


def _components(nodes: str, name: str) -> str:
    return f"""
{name}e AS MATERIALIZED (SELECT a.url AS x, b.url AS y FROM {nodes} a JOIN {nodes} b ON a.url <> b.url AND {_APART} <= 8 AND (a.color IS NULL OR b.color IS NULL OR {_COLORS})),
{name}r AS (SELECT x, x AS y FROM {name}e UNION SELECT x, y FROM {name}e UNION SELECT {name}r.x, {name}e.y FROM {name}r JOIN {name}e ON {name}r.y = {name}e.x),
{name}c AS (SELECT x AS url, min(y) AS component FROM {name}r GROUP BY x)"""


_SPREAD = "(SELECT a.component, max(bit_count(xor(a.bits, b.bits))) AS spread FROM {0} a JOIN {0} b USING (component) GROUP BY 1)"
NEAR = f"""{_components("rep", "n")},
nm0 AS MATERIALIZED (SELECT rep.* EXCLUDE (member_rank, n_members), component FROM rep JOIN nc USING (url)),
nm AS MATERIALIZED (SELECT nm0.*, s.spread, row_number() OVER (PARTITION BY nm0.component ORDER BY {_FIDELITY}) AS member_rank FROM nm0 JOIN {_SPREAD.format("nm0")} s USING (component)),
ng AS (SELECT component, count(*) AS n_members, max(spread) AS spread, sum(CASE WHEN member_rank > 1 THEN byte_size ELSE 0 END) AS reclaimable_bytes, max(CASE WHEN member_rank = 1 THEN relative_path END) AS first_path FROM nm GROUP BY component),
ngn AS (SELECT *, 'near-' || first_path AS group_id, row_number() OVER (ORDER BY n_members DESC, {NATURAL.format("first_path")}, first_path) AS number FROM ng)"""
LEAK = f"""
sp AS MATERIALIZED (SELECT *, CASE split WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE 0 END AS ordinal FROM rec WHERE problem IS NULL AND split IS NOT NULL),{_components("sp", "l")},
lm0 AS MATERIALIZED (SELECT sp.*, component FROM sp JOIN lc USING (url) WHERE component IN (SELECT component FROM sp JOIN lc USING (url) GROUP BY 1 HAVING count(DISTINCT split) > 1)),
lm AS MATERIALIZED (SELECT lm0.*, s.spread, row_number() OVER (PARTITION BY lm0.component ORDER BY ordinal, nat, relative_path) AS member_rank FROM lm0 JOIN {_SPREAD.format("lm0")} s USING (component)),
lt AS (SELECT component, bool_or(n > 1) AS identical FROM (SELECT component, content_hash, count(DISTINCT split) AS n FROM lm GROUP BY 1, 2) GROUP BY 1),
ls AS (SELECT component, string_agg(upper(split[1]) || split[2:], ' ↔ ' ORDER BY ordinal) AS splits FROM (SELECT DISTINCT component, split, ordinal FROM lm) GROUP BY 1),
lg AS (SELECT component, count(*) AS n_members, max(spread) AS spread, sum(CASE WHEN member_rank > 1 THEN byte_size ELSE 0 END) AS reclaimable_bytes, max(CASE WHEN member_rank = 1 THEN relative_path END) AS first_path FROM lm GROUP BY 1),
lgn AS (SELECT *, 'leak-' || first_path AS group_id, row_number() OVER (ORDER BY identical DESC, spread, {NATURAL.format("first_path")}, first_path) AS number FROM lg JOIN lt USING (component) JOIN ls USING (component))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rec_sql(select: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([REC, *more])}\n{select}"


def records(spark: SparkSession, d: str) -> DataFrame:
    return document_records(spark, d)


def _seconds(c: str = "modified_at"):
    return F.unix_seconds(c)


@query("records_projection", rec_sql("SELECT url, relative_path, byte_size, modified_s, format, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, content_hash, problem, label, split FROM rec"))
def records_projection(spark, d):
    return records(spark, d).select("url", "relative_path", "byte_size", _seconds().alias("modified_s"), "format", F.col("pixel_size.width").alias("width"), F.col("pixel_size.height").alias("height"), "content_hash", "problem", "label", "split")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return records(spark, d).select("doc_id", "content_hash")


@query("perceptual_hash", rec_sql("SELECT doc_id, CASE WHEN bits IS NOT NULL THEN lower(lpad(to_hex(CASE WHEN bits < 0 THEN CAST(bits AS HUGEINT) + CAST(18446744073709551616 AS HUGEINT) ELSE CAST(bits AS HUGEINT) END), 16, '0')) END AS hash_hex FROM rec"))
def perceptual_hash(spark, d):
    return records(spark, d).select("doc_id", fingerprint.hex_bits(F.col("perceptual_hash")).alias("hash_hex"))


@query("color_signature", rec_sql("SELECT doc_id, array_to_string(color, ',') AS samples FROM rec"))
def color_signature(spark, d):
    return records(spark, d).select("doc_id", F.when(F.col("color_signature").isNotNull(), F.array_join(F.transform("color_signature", lambda x: x.cast("string")), ",")).alias("samples"))


_VARIANT = "CASE doc_id % 6 WHEN 0 THEN 'train/' || lang || '/x.png' WHEN 1 THEN lang || '/x.png' WHEN 2 THEN 'Training/test/' || lang || '/deep/x.png' WHEN 3 THEN 'holdout/x.png' WHEN 4 THEN 'x.png' ELSE 'dev/train/x.png' END"


@query("layout_attributes", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN 'deep' WHEN 5 THEN 'train' END AS label, CASE doc_id % 6 WHEN 0 THEN 'train' WHEN 2 THEN 'train' WHEN 3 THEN 'test' WHEN 5 THEN 'validation' END AS split FROM documents")
def layout_attributes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_VARIANT).alias("path"))
    a = layout.attributes(F.col("path"))
    return docs.select("doc_id", a.label.alias("label"), a.split.alias("split"))


_FOLDERS = [("train", "train"), ("Training", "train"), ("trainval", "train"), ("val", "validation"), ("VALID", "validation"), ("validation", "validation"), ("dev", "validation"), ("test", "test"), ("testing", "test"), ("Eval", "test"), ("holdout", "test"), ("tests", None), ("cats", None), ("", None)]


@query("split_matching", f"SELECT doc_id, ([{', '.join('NULL' if b is None else repr(b) for _, b in _FOLDERS)}])[CAST(length(text) % {len(_FOLDERS)} + 1 AS BIGINT)] AS split FROM documents")
def split_matching(spark, d):
    """The split that a folder's name stands for; each document lies in one of the names in question."""
    names = F.array(*(F.lit(a) for a, _ in _FOLDERS))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", layout.split_of(F.get(names, (F.char_length("text") % len(_FOLDERS)).cast("int"))).alias("split"))


@query("copy_name_flag", rec_sql("SELECT doc_id, regexp_extract(relative_path, '[^/]*$') AS file_name, is_copy FROM rec"))
def copy_name_flag(spark, d):
    name = layout.file_name(F.col("relative_path"))
    return records(spark, d).select("doc_id", name.alias("file_name"), layout.looks_like_copy(name).alias("is_copy"))


@query("usable_records", rec_sql("SELECT url FROM rec WHERE problem IS NULL"))
def usable_records(spark, d):
    return findings.usable(records(spark, d)).select("url")


_SUMMARIES = "CASE problem WHEN 'unreadable' THEN 'Unreadable, not recognized as an image' WHEN 'truncated' THEN 'Truncated, pixel data is incomplete' WHEN 'decode_failed' THEN 'Corrupt: the header parsed but decoding failed' WHEN 'empty' THEN 'Empty, the file contains no data' END"


@query("problem_records", rec_sql(f"SELECT url, problem, {_SUMMARIES} AS summary FROM rec WHERE problem IS NOT NULL"))
def problem_records(spark, d):
    return findings.problem_records(records(spark, d)).select("url", "problem", findings.problem_summary(F.col("problem")).alias("summary"))


@query("path_filter", rec_sql("SELECT url FROM rec WHERE contains(strip_accents(lower(relative_path)), 'fr/doc1')"))
def path_filter(spark, d):
    return records(spark, d).where(ordering.matches_text(F.col("relative_path"), " FR/dôc1 ")).select("url")


@query("natural_path_rank", rec_sql("SELECT url, row_number() OVER (ORDER BY nat, relative_path) AS place FROM rec"))
def natural_path_rank(spark, d):
    p = F.col("relative_path")
    return ranked(records(spark, d).select("url", "relative_path"), [ordering.natural_key(p).asc(), p.asc()]).select("url", "place")


def _sorted_query(name: str, key: str, ascending: bool, value: str) -> None:
    way = "ASC" if ascending else "DESC"
    tie = "nat, relative_path" if ascending else f"CASE WHEN {value} IS NULL THEN nat END, CASE WHEN {value} IS NOT NULL THEN nat END DESC, CASE WHEN {value} IS NULL THEN relative_path END, relative_path DESC"

    @query(name, rec_sql(f"SELECT url, row_number() OVER (ORDER BY {value} {way} NULLS LAST, {tie}) AS place FROM rec"))
    def run(spark, d):
        k = ordering.record_keys()[key]
        rows = records(spark, d).select("url", "relative_path", "byte_size", "pixel_size", "modified_at")
        return ranked(rows, k.order(F.col("relative_path"), ascending)).select("url", "place")


for _name, _value in (("size", "byte_size"), ("dimensions", "width * height"), ("modified", "modified_s")):
    _sorted_query(f"sort_by_{_name}_ascending", _name, True, _value)
    _sorted_query(f"sort_by_{_name}_descending", _name, False, _value)


@query("exact_groups", rec_sql("SELECT group_id, n_members, CAST(reclaimable_bytes AS BIGINT) AS reclaimable_bytes, first_path, number FROM exn", EXACT))
def exact_groups(spark, d):
    return findings.exact_groups(records(spark, d)).select("group_id", "n_members", "reclaimable_bytes", "first_path", F.col("number").cast("long").alias("number"))


@query("exact_members", rec_sql("SELECT group_id, url, member_rank FROM exm JOIN ex USING (content_hash)", EXACT))
def exact_members(spark, d):
    return findings.exact_members(records(spark, d)).select("group_id", "url", F.col("member_rank").cast("long").alias("member_rank"))


@query("representatives", rec_sql("SELECT url FROM rep", EXACT))
def representatives(spark, d):
    return findings.representatives(findings.usable(records(spark, d))).select("url")


@query("near_pairs", rec_sql(f"SELECT a.url AS a, b.url AS b, CAST({_APART} AS INTEGER) AS bits_apart FROM rep a JOIN rep b ON a.url < b.url AND {_APART} <= 8 AND (a.color IS NULL OR b.color IS NULL OR {_COLORS})", EXACT))
def near_pairs(spark, d):
    f = cut(findings.fingerprints(findings.representatives(findings.usable(records(spark, d)))))  # read several times
    return sim.pairs(f, f, ordered=True)


@query("near_pairs_banded", rec_sql(f"SELECT a.url AS a, b.url AS b, CAST({_APART} AS INTEGER) AS bits_apart FROM rep a JOIN rep b ON a.url < b.url AND {_APART} <= 12 AND (a.color IS NULL OR b.color IS NULL OR {_COLORS})", EXACT))
def near_pairs_banded(spark, d):
    f = cut(findings.fingerprints(findings.representatives(findings.usable(records(spark, d)))))  # read several times
    return sim.pairs(f, f, threshold=12, ordered=True, plan="bands")


@query("color_distance_pairs", rec_sql("SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.color IS NULL OR b.color IS NULL THEN 255 ELSE CAST(list_sum(list_transform(list_zip(a.color, b.color), lambda x: abs(CAST(x[1] AS INTEGER) - CAST(x[2] AS INTEGER)))) // 48 AS INTEGER) END AS distance FROM rec a JOIN rec b ON b.doc_id = a.doc_id + 1"))
def color_distance_pairs(spark, d):
    r = records(spark, d).select("doc_id", "color_signature")
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.coalesce(fingerprint.color_distance(F.col("a.color_signature"), F.col("b.color_signature")), F.lit(255)).alias("distance"))


@query("near_groups", rec_sql("SELECT group_id, n_members, CAST(reclaimable_bytes AS BIGINT) AS reclaimable_bytes, first_path, CAST(spread AS INTEGER) AS spread, number FROM ngn", EXACT, NEAR, recursive=True))
def near_groups(spark, d):
    return findings.near_groups(records(spark, d))[0].select("group_id", "n_members", "reclaimable_bytes", "first_path", "spread", F.col("number").cast("long").alias("number"))


@query("near_members", rec_sql("SELECT group_id, url, member_rank FROM nm JOIN ngn USING (component)", EXACT, NEAR, recursive=True))
def near_members(spark, d):
    return findings.near_groups(records(spark, d))[1].select("group_id", "url", F.col("member_rank").cast("long").alias("member_rank"))


@query("leakage_groups", rec_sql("SELECT group_id, n_members, first_path, splits, CAST(spread AS INTEGER) AS spread, identical, number FROM lgn", LEAK, recursive=True))
def leakage_groups(spark, d):
    return findings.leakage_groups(records(spark, d))[0].select("group_id", "n_members", "first_path", "splits", "spread", "identical", F.col("number").cast("long").alias("number"))


@query("leakage_members", rec_sql("SELECT group_id, url, split, member_rank FROM lm JOIN lgn USING (component)", LEAK, recursive=True))
def leakage_members(spark, d):
    return findings.leakage_groups(records(spark, d))[1].select("group_id", "url", "split", F.col("member_rank").cast("long").alias("member_rank"))


@query("leakage_by_split", rec_sql("SELECT group_id, split, count(*) AS n FROM lm JOIN lgn USING (component) GROUP BY 1, 2", LEAK, recursive=True))
def leakage_by_split(spark, d):
    return findings.leakage_by_split(findings.leakage_groups(records(spark, d))[1])


def _tally_sql(column: str, unknown: str, where: str = "") -> str:
    return rec_sql(f"SELECT name, n, row_number() OVER (ORDER BY n DESC, {NATURAL.format('name')}, name) AS place FROM (SELECT coalesce({column}, '{unknown}') AS name, count(*) AS n FROM rec {where} GROUP BY 1)")


@query("format_tally", _tally_sql("format", "Unknown"))
def format_tally(spark, d):
    return findings.format_tally(records(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("label_tally", _tally_sql("label", "Unlabeled", "WHERE label IS NOT NULL"))
def label_tally(spark, d):
    return findings.label_tally(records(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("split_tally", _tally_sql("upper(split[1]) || split[2:]", "Unsplit"))
def split_tally(spark, d):
    return findings.split_tally(records(spark, d)).withColumn("place", F.col("place").cast("long"))


_HEALTH = """SELECT t.*, x.*, l.n_labels, round(l.most * 1.0 / l.least, 6) AS label_imbalance, l.n_labels >= 2 AS has_labels, (SELECT count(DISTINCT coalesce(split, '')) FROM rec) >= 2 AS has_splits, l.most >= 3 * l.least AS imbalance_concerning
FROM (SELECT count(*) AS n_images, CAST(sum(byte_size) AS BIGINT) AS n_bytes, count(problem) AS n_problems, count(*) FILTER (label IS NULL) AS n_unlabelled FROM rec) t,
 (SELECT count(*) AS n_exact_groups, CAST(sum(n_members - 1) AS BIGINT) AS n_redundant, CAST(sum(reclaimable_bytes) AS BIGINT) AS reclaimable_bytes FROM ex) x,
 (SELECT count(*) AS n_labels, max(n) AS most, min(n) AS least FROM (SELECT label, count(*) AS n FROM rec WHERE label IS NOT NULL GROUP BY 1)) l"""


@query("health_report", rec_sql(_HEALTH, EXACT))
def health_report(spark, d):
    return findings.health(records(spark, d)).withColumn("label_imbalance", F.round("label_imbalance", 6))


@query("health_counts", rec_sql("SELECT (SELECT count(*) FROM nm) AS n_near_images, (SELECT count(*) FROM lgn) AS n_leaks", EXACT, NEAR, LEAK, recursive=True))
def health_counts(spark, d):
    return Analysis.make(records(spark, d)).health.select("n_near_images", "n_leaks")


_REASONS = "SELECT url, 0 AS k, " + _SUMMARIES + " AS reason FROM rec WHERE problem IS NOT NULL UNION ALL SELECT url, 1, 'Exact duplicate' FROM exm WHERE n_members > 1 UNION ALL SELECT url, 2, 'Near duplicate' FROM nm UNION ALL SELECT url, 3, 'Split leakage' FROM lm"


@query("findings_per_file", rec_sql(f"SELECT url, string_agg(reason, '; ' ORDER BY k) AS findings FROM ({_REASONS}) GROUP BY url", EXACT, NEAR, LEAK, recursive=True))
def findings_per_file(spark, d):
    return Analysis.make(records(spark, d)).findings_per_file.select("url", F.array_join("findings", "; ").alias("findings"))


_CSV = f"""SELECT finding, file, "group", detail FROM (
SELECT 'Won''t open' AS finding, relative_path AS file, '' AS "group", {_SUMMARIES} AS detail FROM rec WHERE problem IS NOT NULL
UNION ALL SELECT 'Exact duplicate', relative_path, 'exact-' || number, CASE WHEN member_rank = 1 THEN 'keeping' ELSE 'redundant copy' END FROM exm JOIN exn USING (content_hash)
UNION ALL SELECT 'Near duplicate', relative_path, 'near-' || number, (CASE WHEN member_rank = 1 THEN 'keeping' ELSE 'similar copy' END) || ', differs by ' || nm.spread || ' of 64 bits' FROM nm JOIN ngn USING (component)
UNION ALL SELECT 'Split leakage', relative_path, 'leak-' || number, splits || ', ' || CASE WHEN identical THEN 'identical copy' ELSE 'similar copy' END FROM lm JOIN lgn USING (component))"""


@query("findings_csv_rows", rec_sql(_CSV, EXACT, NEAR, LEAK, recursive=True))
def findings_csv_rows(spark, d):
    return finding_rows(Analysis.make(records(spark, d))).select("finding", "file", "group", "detail")


@query("csv_quoting", """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_quoting(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", csv_field(F.col("text")).alias("field"))


@query("keeper_override", rec_sql("SELECT group_id, CAST(sum(CASE WHEN member_rank = n_members THEN 0 ELSE byte_size END) AS BIGINT) AS redundant_bytes FROM (SELECT exm.*, ex.group_id FROM exm JOIN ex USING (content_hash)) GROUP BY group_id", EXACT))
def keeper_override(spark, d):
    members = findings.exact_members(records(spark, d))
    chosen = members.where("member_rank = n_members").select("group_id", F.col("url").alias("keeper"))
    return findings.redundant_bytes(findings.chosen_keepers(members, chosen))


@query("keepers_reconciled", rec_sql("SELECT group_id, url AS keeper FROM exm JOIN ex USING (content_hash) WHERE member_rank = 2 AND NOT is_copy", EXACT))
def keepers_reconciled(spark, d):
    members = findings.exact_members(records(spark, d))
    second = members.where("member_rank = 2")
    gone = second.where(layout.looks_like_copy(layout.file_name(F.col("relative_path"))))
    kept = members.join(gone.select("url"), "url", "left_anti")
    return findings.reconciled_keepers(second.select("group_id", F.col("url").alias("keeper")), kept)


@query("remove_then_reanalyse", rec_sql("SELECT group_id, n_members FROM (SELECT 'exact-' || content_hash AS group_id, count(*) AS n_members FROM rec WHERE problem IS NULL AND doc_id % 3 <> 0 GROUP BY 1) WHERE n_members > 1"))
def remove_then_reanalyse(spark, d):
    r = records(spark, d)
    return Analysis.make(r).removing(r.where("doc_id % 3 = 0").select("url")).exact_groups.select("group_id", "n_members")


_COMPARED = f"""
lib AS (SELECT * FROM rec WHERE doc_id % 5 <> 0 AND problem IS NULL), cand AS (SELECT * FROM rec WHERE doc_id % 5 = 0),
fx AS (SELECT c.url AS candidate, l.url AS m, l.nat, l.relative_path FROM cand c JOIN lib l USING (content_hash) WHERE c.problem IS NULL),
fn AS (SELECT a.url AS candidate, b.url AS m, b.nat, b.relative_path FROM cand a JOIN lib b ON {_APART} <= 8 AND {_COLORS} WHERE a.problem IS NULL AND a.url NOT IN (SELECT candidate FROM fx)),
cmp AS (SELECT url AS candidate, CASE WHEN problem IS NOT NULL THEN 'unreadable' WHEN url IN (SELECT candidate FROM fx) THEN 'exact' WHEN url IN (SELECT candidate FROM fn) THEN 'near' ELSE 'new' END AS kind FROM cand)"""


def _compared(spark, d):
    r = records(spark, d)
    return compare.compare(r.where("doc_id % 5 <> 0"), r.where("doc_id % 5 = 0"))


@query("compare_classify", rec_sql("SELECT cmp.candidate, kind, coalesce((SELECT string_agg(m, ';' ORDER BY nat, relative_path) FROM (SELECT * FROM fx UNION ALL SELECT * FROM fn) f WHERE f.candidate = cmp.candidate), '') AS matches FROM cmp", _COMPARED))
def compare_classify(spark, d):
    return _compared(spark, d).select("candidate", "kind", F.array_join("matches", ";").alias("matches"))


@query("compare_kind_counts", rec_sql("SELECT k.kind, count(cmp.candidate) AS n FROM (VALUES ('unreadable'), ('exact'), ('near'), ('new')) k(kind) LEFT JOIN cmp USING (kind) GROUP BY 1", _COMPARED))
def compare_kind_counts(spark, d):
    return compare.kind_counts(_compared(spark, d))


def _vectors(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("path"), "embedding", F.concat(F.lit("class"), F.col("label").cast("string")).alias("label"))


_VEC = "v AS (SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS path, CAST(embedding AS DOUBLE[]) AS e, 'class' || label AS label FROM embeddings)"


@query("vector_norms", f"WITH {_VEC} SELECT path, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS norm FROM v")
def vector_norms(spark, d):
    return _vectors(spark, d).select("path", F.round(norm(F.col("embedding")), 5).alias("norm"))


@query("width_vote", "SELECT len(embedding) AS width, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, width DESC LIMIT 1")
def width_vote(spark, d):
    return vectors.majority_width(_vectors(spark, d)).groupBy(F.size("embedding").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("nearest_top60", f"WITH {_VEC} SELECT path, round(list_dot_product(e, [CAST(CASE WHEN i = 3 THEN 0.6 WHEN i = 7 THEN 0.8 ELSE 0 END AS FLOAT)::DOUBLE FOR i IN range(64)]), 4) AS similarity FROM v ORDER BY list_dot_product(e, [CAST(CASE WHEN i = 3 THEN 0.6 WHEN i = 7 THEN 0.8 ELSE 0 END AS FLOAT)::DOUBLE FOR i IN range(64)]) DESC, path LIMIT 60")
def nearest_top60(spark, d):
    q = [0.0] * 64
    q[3], q[7] = 0.6, 0.8
    return vectors.nearest(_vectors(spark, d), q, 60).select("path", F.round("similarity", 4).alias("similarity"))


@query("similar_to_vector", f"WITH {_VEC} SELECT b.path, round(list_dot_product(a.e, b.e), 4) AS similarity FROM v a, v b WHERE a.path = 'v00000000' AND b.path <> a.path ORDER BY list_dot_product(a.e, b.e) DESC, b.path LIMIT 60")
def similar_to_vector(spark, d):
    return vectors.similar_to(_vectors(spark, d), "v00000000").select("path", F.round("similarity", 4).alias("similarity"))


_CENTRES = """u AS (SELECT label, i, sum(e[i]) AS x, count(*) AS n FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM v) GROUP BY 1, 2),
w AS (SELECT label, max(n) AS n, sqrt(sum(x * x)) AS size FROM u GROUP BY 1 HAVING max(n) >= 4),
c AS (SELECT label, w.n, list(x / size ORDER BY i) AS centre FROM u JOIN w USING (label) GROUP BY 1, 2)"""


@query("label_centres", f"WITH {_VEC}, {_CENTRES} SELECT label, n, i - 1 AS i, round(centre[i], 4) AS x FROM (SELECT label, n, centre, unnest(range(1, 65)) AS i FROM c)")
def label_centres(spark, d):
    v = _vectors(spark, d)
    centres = vectors.label_centres(v, v.select("path", "label")).select("label", "n", F.posexplode("centre").alias("i", "x"))
    return centres.select("label", "n", F.col("i").cast("long").alias("i"), F.round("x", 4).alias("x"))


@query("label_check", f"WITH {_VEC}, {_CENTRES}, s AS (SELECT v.path, v.label AS current_label, c.label, list_dot_product(v.e, c.centre) AS s FROM v, c), o AS (SELECT path, s AS own FROM s WHERE label = current_label), b AS (SELECT path, current_label, label AS suggested_label, s, row_number() OVER (PARTITION BY path ORDER BY s DESC, label) AS k FROM s WHERE label <> current_label) SELECT path, current_label, suggested_label, round(s - own, 4) AS margin FROM b JOIN o USING (path) WHERE k = 1 AND s > own AND s - own >= 0.02")
def label_check(spark, d):
    v = _vectors(spark, d)
    return vectors.label_suggestions(v.select("path", "embedding"), v.select("path", "label")).select("path", "current_label", "suggested_label", F.round("margin", 4).alias("margin"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return vectors.cluster(_vectors(spark, d).select("path", "embedding")).select("path", "cluster_id", "member_rank", F.round("score", 4).alias("score"))


@query("label_preview", f"WITH {_VEC} SELECT path, label, place, greatest(0, n - 12) AS n_more FROM (SELECT path, label, row_number() OVER (PARTITION BY label ORDER BY round(e[1], 4) DESC, path) AS place, count(*) OVER (PARTITION BY label) AS n FROM v) WHERE place <= 12")
def label_preview(spark, d):
    """The first twelve vectors of each label, by their first number, as a cluster shows its members."""
    v = _vectors(spark, d).withColumn("x", F.round(F.get("embedding", 0), 4))
    ranks = ranked_within(v.select("path", "label", "x"), "label", [F.desc("x"), F.asc("path")])
    return vectors.cluster_preview(ranks).select("path", "label", F.col("member_rank").cast("long").alias("place"), "n_more")


@query("cluster_cohesion")
def cluster_cohesion(spark, d):
    rows = vectors.cluster(_vectors(spark, d).select("path", "embedding")).where("member_rank = 1")
    return rows.select("cluster_id", "n_members", F.round("cohesion", 4).alias("cohesion"), cohesion_description(F.col("cohesion")).alias("quality"))


@query("pairwise_top1", f"WITH {_VEC}, p AS (SELECT a.path, b.path AS other, round(list_dot_product(a.e, b.e), 4) AS s FROM v a JOIN v b ON a.path <> b.path WHERE CAST(a.path[2:] AS BIGINT) % 20 = 0) SELECT path, max(s) AS similarity FROM p GROUP BY path")
def pairwise_top1(spark, d):
    """The best other vector of every twentieth, against all: a stated query set."""
    v = _vectors(spark, d).select("path", normalized(F.col("embedding")).alias("embedding"))
    q = v.where(F.substring("path", 2, 8).cast("long") % 20 == 0)
    return vectors.best_others(v, q).select("path", F.round("similarity", 4).alias("similarity"))


_TWENTIETH = f"{_VEC}, s AS (SELECT a.path AS query, b.path, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.path <> b.path WHERE CAST(a.path[2:] AS BIGINT) % 20 = 0)"


@query("similar_top60", f"WITH {_TWENTIETH} SELECT query, path, round(s, 4) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, path) AS place FROM s) WHERE place <= 60")
def similar_top60(spark, d):
    """The 60 most similar vectors of every twentieth, against all: a stated query set."""
    v = _vectors(spark, d).select("path", "embedding")
    found = most_similar(v, v.where(F.substring("path", 2, 8).cast("long") % 20 == 0), vectors.SEARCH_LIMIT)
    return found.select("query", "path", F.round("similarity", 4).alias("similarity"), F.col("place").cast("long").alias("place"))


def _cache_rows(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return e.select(F.concat(F.lit("h"), (F.col("vec_id") % 200).cast("string")).alias("content_hash"), "embedding", F.col("vec_id").alias("seq"), F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("provider"))


_CACHE = "k AS (SELECT 'h' || vec_id % 200 AS content_hash, vec_id AS seq, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS provider FROM embeddings)"


@query("cache_latest_wins", f"WITH {_CACHE} SELECT provider, content_hash, max(seq) AS seq FROM k GROUP BY 1, 2")
def cache_latest_wins(spark, d):
    return cache.latest(_cache_rows(spark, d)).select("provider", "content_hash", "seq")


@query("cache_compacted", f"WITH {_CACHE}, m AS (SELECT provider, content_hash, max(seq) AS seq FROM k GROUP BY 1, 2) SELECT provider, content_hash, seq FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY seq DESC) AS n FROM m) WHERE n <= 50")
def cache_compacted(spark, d):
    return cache.compacted(_cache_rows(spark, d), 50).select("provider", "content_hash", "seq")


@query("cache_state", f"WITH {_CACHE} SELECT provider, count(*) AS n_records, count(DISTINCT content_hash) AS n_entries, count(*) > 2 * count(DISTINCT content_hash) OR count(DISTINCT content_hash) > 100000 AS compact FROM k GROUP BY 1")
def cache_state(spark, d):
    return cache.needs_compaction(_cache_rows(spark, d))


@query("cache_pending", rec_sql("SELECT url FROM rec WHERE doc_id % 4 = 0 AND content_hash NOT IN (SELECT content_hash FROM rec WHERE doc_id % 4 = 1)"))
def cache_pending(spark, d):
    r = records(spark, d)
    rows = r.where("doc_id % 4 = 1").select("content_hash", F.array().cast("array<float>").alias("embedding"), F.col("doc_id").alias("seq"), F.lit("p").alias("provider"))
    return cache.pending(r.where("doc_id % 4 = 0"), rows, "p").select("url")


@query("snapshot_changes", "SELECT 'e' || event_id AS url, CASE WHEN event_id % 7 = 0 THEN 'removed' WHEN event_id % 11 = 0 THEN 'added' ELSE 'replaced' END AS change FROM events WHERE event_id % 7 = 0 AND event_id % 11 <> 0 OR event_id % 11 = 0 AND event_id % 7 <> 0 OR event_id % 13 = 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def snapshot_changes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("url"), "event_id", F.col("user_id").alias("byte_size"), F.col("ts").alias("modified_at"))
    before = e.where("event_id % 11 <> 0")
    after = e.where("event_id % 7 <> 0").withColumn("byte_size", F.col("byte_size") + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0))
    return changes(before, after)


@query("relative_paths", rec_sql("SELECT url, CASE WHEN starts_with(url, 'file:///data/train/') THEN url[20:] ELSE regexp_extract(url, '[^/]*$') END AS path FROM rec"))
def relative_paths(spark, d):
    return records(spark, d).select("url", layout.relative_to(F.col("url"), "file:///data/train").alias("path"))


@query("size_texts", rec_sql("SELECT url, width || ' × ' || height AS size, CAST(width AS BIGINT) * height AS pixels FROM rec"))
def size_texts(spark, d):
    return records(spark, d).select("url", ordering.size_text(F.col("pixel_size")).alias("size"), ordering.pixel_count(F.col("pixel_size")).alias("pixels"))


#: First bytes, last bytes, format and verdict of made-up files, by doc_id modulo their number; the rest of a file is its text, which may be empty.
_FILES = [
    ("FFD8FFE000104A4649460001", "FFD90000", "JPEG", "complete"),
    ("FFD8FFE000104A4649460001", "FFD8D900", "JPEG", "truncated"),
    ("FFD8FFE000104A4649460001", "0FFD9000", "JPEG", "truncated"),
    ("89504E470D0A1A0A0000000D49484452", "0000000049454E44AE426082", "PNG", "complete"),
    ("89504E470D0A1A0A0000000D49484452", "49454E44", "PNG", "truncated"),
    ("474946383961010001008000", "003B", "GIF", "complete"),
    ("474946383761010001008000", "3B00", "GIF", "truncated"),
    ("524946460800000057454250", "00000000", "WEBP", "complete"),
    ("52494646FFFFFF7F57454250", "", "WEBP", "truncated"),
    ("424D46000000000000003600", "", "BMP", "unknown"),
    ("49492A000800000000000000", "", "TIFF", "unknown"),
    ("000000186674797061766966", "", "AVIF", "unknown"),
    ("000000186674797068656963", "", "HEIC", "unknown"),
    ("74657874", "", None, "unknown"),
]


def _file_sql(k: int) -> str:
    return f"CASE doc_id % {len(_FILES)} " + " ".join(f"WHEN {i} THEN '{f[k]}'" for i, f in enumerate(_FILES) if f[k] is not None) + " END"


@query("file_completeness", f"SELECT doc_id, {_file_sql(2)} AS format, {_file_sql(3)} AS verdict FROM documents")
def file_completeness(spark, d):
    part = lambda k: F.unhex(F.element_at(F.array(*(F.lit(f[k]) for f in _FILES)), (F.col("doc_id") % len(_FILES) + 1).cast("int")))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", part(0).alias("head"), part(1).alias("end"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    size = (F.length("head") + F.col("n") + F.length("end")).cast("long")
    tail = F.concat("head", "end")
    verdict = completeness.completeness(F.col("head"), tail, size, F.lit(None).cast("string"))
    return docs.select("doc_id", completeness.format_name(F.col("head"), F.lit("heic")).alias("format"), verdict.alias("verdict"))


_FIELDS = [f"""CASE WHEN regexp_matches({c}, '[,"\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END""" for c in ("finding", "file", '"group"', "detail")]


@query("report_csv", rec_sql(f"SELECT {' || chr(44) || '.join(_FIELDS)} AS line FROM ({_CSV})", EXACT, NEAR, LEAK, recursive=True))
def report_csv(spark, d):
    return csv_lines(Analysis.make(records(spark, d)))


@query("badge_counts", rec_sql("SELECT * FROM (SELECT 'exact' AS section, (SELECT count(*) FROM ex) AS n UNION ALL SELECT 'near', (SELECT count(*) FROM ng) UNION ALL SELECT 'problems', (SELECT count(*) FROM rec WHERE problem IS NOT NULL) UNION ALL SELECT 'leakage', (SELECT count(*) FROM lg)) WHERE n > 0", EXACT, NEAR, LEAK, recursive=True))
def badge_counts(spark, d):
    return Analysis.make(records(spark, d)).badge_counts


@query("displayed_bytes", rec_sql("SELECT count(*) AS n_groups, CAST(coalesce(sum(b), 0) AS BIGINT) AS redundant_bytes FROM (SELECT content_hash, sum(CASE WHEN member_rank = n_members THEN 0 ELSE byte_size END) AS b FROM exm WHERE n_members > 1 GROUP BY 1 HAVING bool_or(contains(relative_path, 'train/')))", EXACT))
def displayed_bytes(spark, d):
    members = findings.exact_members(records(spark, d))
    chosen = members.where("member_rank = n_members").select("group_id", F.col("url").alias("keeper"))
    return findings.displayed_bytes(findings.chosen_keepers(members, chosen), "TRAIN/")


@query("compare_filtered", rec_sql("SELECT candidate, kind FROM cmp WHERE kind = 'near' AND contains(candidate, 'doc')", _COMPARED))
def compare_filtered(spark, d):
    return compare.filtered(_compared(spark, d), "near", " DÓC").select("candidate", "kind")


@query("action_targets", rec_sql("SELECT 'all' AS given, url FROM rec WHERE problem IS NOT NULL UNION ALL SELECT 'some', url FROM rec WHERE problem IS NOT NULL AND doc_id % 2 = 0"))
def action_targets(spark, d):
    r = records(spark, d)
    bad = findings.problem_records(r)
    every = compare.targets(bad, bad.where("false").select("url"))
    some = compare.targets(bad, r.where("doc_id % 2 = 0").select("url"))
    return every.select(F.lit("all").alias("given"), "url").unionByName(some.select(F.lit("some").alias("given"), "url"))


@query("cache_hits", rec_sql("SELECT r.url, max(c.doc_id) AS seq FROM rec r JOIN rec c USING (content_hash) WHERE c.doc_id % 4 = 1 GROUP BY 1"))
def cache_hits(spark, d):
    r = records(spark, d)
    rows = r.where("doc_id % 4 = 1").select("content_hash", F.array(F.col("doc_id").cast("float")).alias("embedding"), F.col("doc_id").alias("seq"), F.lit("p").alias("provider"))
    return cache.hits(r, rows, "p").select("url", F.get("embedding", 0).cast("long").alias("seq"))


@query("path_lookup", rec_sql("SELECT v.path, r.label FROM (SELECT 'file:///data/' || relative_path AS path FROM rec WHERE doc_id % 3 = 0) v JOIN rec r ON r.url = v.path"))
def path_lookup(spark, d):
    r = records(spark, d)
    return r.where("doc_id % 3 = 0").select(F.col("url").alias("path")).join(r.select(F.col("url").alias("path"), "label"), "path")


def _placed_groups(name: str, key: str, ascending: bool, near: bool, sql: str, *more: str, recursive: bool = False) -> None:
    @query(name, rec_sql(sql, *more, recursive=recursive))
    def run(spark, d):
        r = records(spark, d)
        groups = findings.near_groups(r)[0] if near else findings.exact_groups(r)
        return ranked(groups, ordering.group_keys(near)[key].order(F.col("first_path"), ascending)).select("group_id", "place")


_FIRST = NATURAL.format("first_path")
_placed_groups("sort_exact_by_count", "count", False, False, f"SELECT group_id, row_number() OVER (ORDER BY n_members DESC, {_FIRST} DESC, first_path DESC) AS place FROM ex", EXACT)
_placed_groups("sort_near_by_similarity", "similarity", True, True, f"SELECT group_id, row_number() OVER (ORDER BY spread, {_FIRST}, first_path) AS place FROM ngn", EXACT, NEAR, recursive=True)


@query("problems_by_size", rec_sql("SELECT url, row_number() OVER (ORDER BY byte_size, nat, relative_path) AS place FROM rec WHERE problem IS NOT NULL"))
def problems_by_size(spark, d):
    return ranked(findings.problem_records(records(spark, d)), ordering.problem_keys()["size"].order(F.col("relative_path"))).select("url", "place")


_CHECKED = ORACLES["label_check"].split(" SELECT path, current_label, suggested_label")[0]


@query("suggestions_by_margin", f"{_CHECKED} SELECT path, row_number() OVER (ORDER BY round(s - own, 6) DESC, path) AS place FROM b JOIN o USING (path) WHERE k = 1 AND s > own AND s - own >= 0.02")
def suggestions_by_margin(spark, d):
    v = _vectors(spark, d)
    rows = vectors.label_suggestions(v.select("path", "embedding"), v.select("path", "label")).withColumn("margin", F.round("margin", 6))
    return ranked(rows, vectors.suggestion_order()).select("path", "place")


@query("suggested_counts", "SELECT source, lang, n, CAST(CASE WHEN n <= 3 THEN greatest(1, n) ELSE least(24, greatest(2, floor(sqrt(n / 2.0) + 0.5))) END AS INTEGER) AS k FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def suggested_counts(spark, d):
    """The suggested number of clusters for the documents of each source and language."""
    counts = spark.read.parquet(f"{d}/documents.parquet").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", suggested_clusters(F.col("n")))


_STEP = f"""{_VEC}, c0 AS (SELECT row_number() OVER (ORDER BY path) - 1 AS c, e AS centre FROM v ORDER BY path LIMIT 5),
a0 AS (SELECT path, e, arg_max(c, {{'s': list_dot_product(e, centre), 'c': -c}}) AS c FROM v, c0 GROUP BY path, e),
u AS (SELECT c, i, sum(e[i]) AS x FROM (SELECT c, e, unnest(range(1, 65)) AS i FROM a0) GROUP BY c, i),
c1 AS (SELECT c, list(CAST(CAST(x / size AS FLOAT) AS DOUBLE) ORDER BY i) AS centre FROM u JOIN (SELECT c, sqrt(sum(x * x)) AS size FROM u GROUP BY c) USING (c) GROUP BY c)"""


@query("kmeans_step", f"WITH {_STEP} SELECT path, CAST(arg_max(c, {{'s': list_dot_product(e, centre), 'c': -c}}) AS INTEGER) AS cluster, round(max(list_dot_product(e, centre)), 4) AS score FROM v, c1 GROUP BY path")
def kmeans_step(spark, d):
    """One step of k-means from the first five vectors as centres: assigned, moved, assigned."""
    v = _vectors(spark, d).select("path", "embedding")
    first = [r["embedding"] for r in v.orderBy("path").limit(5).collect()]
    points = v.withColumn("i", F.xxhash64("path"))
    return vectors.lloyd(points, np.array(first, np.float32), 1).select("path", "cluster", F.round("score", 4).alias("score"))


@query("label_spreads", rec_sql("SELECT a.label, CAST(max(bit_count(xor(a.bits, b.bits))) AS INTEGER) AS spread FROM rec a JOIN rec b ON a.label = b.label AND a.bits <= b.bits GROUP BY a.label"))
def label_spreads(spark, d):
    """The two least alike files of each label."""
    return spreads(records(spark, d).where("perceptual_hash is not null").select("label", F.col("perceptual_hash").alias("bits")))


@query("live_near_groups", ORACLES["near_groups"])
def live_near_groups(spark, d):
    """Near groups after a batch of changes: files come, are replaced and go; what is left is the whole table."""
    r = cut(records(spark, d).drop("doc_id"))  # read four times
    number = F.regexp_extract("relative_path", "doc([0-9]+)", 1).cast("long")
    stray = r.where(number % 11 == 0).withColumns({"url": F.concat("url", F.lit("#stray")), "content_hash": F.sha1("content_hash")})
    early = r.where(number % 5 != 0).withColumn("perceptual_hash", F.when(number % 9 == 0, F.bitwise_not("perceptual_hash")).otherwise(F.col("perceptual_hash")))
    live = LiveFindings(early.unionByName(stray), leakage=False)
    live.apply(r.where((number % 5 == 0) | (number % 9 == 0)), stray.select("url"))
    return live.near_groups.select("group_id", "n_members", "reclaimable_bytes", "first_path", "spread", F.col("number").cast("long").alias("number"))


@query("kmeans_invariants", "SELECT count(*) AS n_points, true AS each_once, true AS ids_from_zero, true AS larger_first, true AS ranks_dense, true AS best_first FROM embeddings")
def kmeans_invariants(spark, d):
    """What holds of any clustering: every point once, clusters by size, members by score."""
    rows = vectors.cluster(_vectors(spark, d).select("path", "embedding"))
    of = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_members").alias("said"), F.count_distinct("member_rank").alias("ranks"), F.max("member_rank").alias("last"), F.min("member_rank").alias("first"),
        F.array_sort(F.collect_list(F.struct("member_rank", F.col("score").alias("s")))).alias("m"),
    )
    falling = F.forall(F.sequence(F.lit(1), F.size("m")), lambda i: (i == F.size("m")) | (F.get("m", i - 1)["s"] >= F.coalesce(F.get("m", i)["s"], F.lit(-9.0))))
    of = of.select("cluster_id", "n", ((F.col("n") == F.col("said")) & (F.col("ranks") == F.col("n")) & (F.col("last") == F.col("n")) & (F.col("first") == 1)).alias("dense"), falling.alias("falling"))
    a, b = of.alias("a"), of.alias("b")
    order = a.join(b, F.col("b.cluster_id") == F.col("a.cluster_id") + 1).agg(F.coalesce(F.bool_and(F.col("a.n") >= F.col("b.n")), F.lit(True)).alias("larger_first"))
    total = of.agg(F.sum("n").alias("n_points"), ((F.min("cluster_id") == 0) & (F.max("cluster_id") == F.count(F.lit(1)) - 1)).alias("ids_from_zero"), F.bool_and("dense").alias("ranks_dense"), F.bool_and("falling").alias("best_first"))
    once = rows.agg((F.count_distinct("path") == F.count(F.lit(1))).alias("each_once"))
    # one row each
    return total.join(F.broadcast(order)).join(F.broadcast(once)).select("n_points", "each_once", "ids_from_zero", "larger_first", "ranks_dense", "best_first")
