"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Base expressions find seed entities of four kinds; tokens shaped like keys (long
hexadecimal runs) are seeds of a fifth, secrets, that count only where their
context confirms them.  Words around an entity are its lexical patterns, with a
slot for the entity: `w _`, `v w _`, `u v w _` and `w _ x`.  Other identifier-like
tokens (with a digit or an @) in the slots of the same patterns are instances
whose kind isn't known yet.  Patterns and instances form a graph that Spark scores
in rounds until nothing changes: a pattern is as good as the share of its
instances that are known to be of one kind, and instances of good patterns
become known, to be found wherever they occur.

A pattern must have SEEDS distinct instances of a kind, be right about CONFIDENCE
of those whose shape decides, and have such an instance in its slot in FREQUENCY of
all its occurrences in the corpus, so that common contexts never are patterns.

Words are lower-cased runs between white space; one of more than WORD_CHARS code
points is in no pattern.  The words of a context lie between an entity and the one
before it (or between identifier-like tokens).

Positions come from the gaps between matches, in code points.  Null and empty
texts have no spans.  What is found in a row depends on its own text and on the
patterns alone: rows that share a doc_id, or have none, never share spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, table, unused

#: The base kinds, and those that only patterns find.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SECRET = KINDS.index("secret")
SEEDS = 3
CONFIDENCE = 0.7
FREQUENCY = 0.5
#: Up to so many words that end promising contexts are looked up as a literal set; more are joined.
LITERAL_WORDS = 5_000
#: Up to so many added spans or patterns (counted; a pattern has at most four words of WORD_CHARS) are broadcast to rows.
FEW = 100_000
#: Matches that one step of the running position handles; keeps long lists from quadratic cost.
STEP = 256
#: Code points of a pattern's longest word, and of the stretch that holds three of them.
WORD_CHARS, CONTEXT = 64, 256

#: The base expressions; possessive, and started only where a run starts, so that they take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a match to be possible.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Shapes of keys: certain enough for a seed, and possible at all.
SECRET_SEED = r"^(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128}$"
SECRET_SHAPE = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=.-]{16,256}$"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_ENTITY = "start:bigint,kind:int,stop:bigint,value:string,left:string,right:string"
_FOUND = "array<struct<start:bigint,stop:bigint,value:string,left:string,right:string>>"
_SPAN = "struct<start:bigint,kind:int,stop:bigint>"


def _bound(x: Column, f) -> Column:
    return F.element_at(F.transform(F.array(x), f), 1)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _running(items: Column, zero: Column, one, kind: str) -> Column:
    """The concatenated out of a fold over items with a state of (pos, out), in steps, so that no long array is copied for each item."""

    def step(state: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(items, k * STEP + 1, STEP), F.struct(state["pos"].alias("pos"), _none(kind).alias("out")), one)
        return _bound(part, lambda p: F.struct(p["pos"].alias("pos"), F.concat(state["out"], F.array(p["out"])).alias("out")))

    steps = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int"))
    start = F.struct(zero.alias("pos"), _none(f"array<{kind}>").alias("out"))
    return F.when(F.size(items) == 0, _none(kind)).otherwise(F.flatten(F.aggregate(steps, start, step)["out"]))


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches in order, as (start, stop, value, left, right): code points, and the text beside, up to CONTEXT."""

    def one(state: Column, x: Column) -> Column:
        start = state["pos"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        left = F.right(x["gap"], F.lit(CONTEXT))
        # a word that the stretch cuts isn't one of the last three that may form patterns
        left = F.when(F.length(x["gap"]) > CONTEXT, F.regexp_replace(left, rf"^[^{SPACE}]+", "")).otherwise(left)
        item = F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"), left.alias("left"), F.left(x["next"], F.lit(CONTEXT)).alias("right"))
        return F.struct(stop.alias("pos"), F.concat(state["out"], F.array(item)).alias("out"))

    def placed(gaps: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.transform(values, lambda v, i: F.struct(F.get(gaps, i).alias("gap"), v.alias("value"), F.get(gaps, i + 1).alias("next")))
        return _bound(pairs, lambda p: _running(p, F.lit(0).cast("long"), one, _FOUND))

    return _bound(F.split(text, pattern, -1), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_entities(text: Column) -> Column:
    """Base spans by start, then kind: (start, kind, stop, value, left, right), kind by number."""
    text = F.coalesce(text, F.lit(""))

    def of(number: int, kind: str) -> Column:
        hits = F.filter(found(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
        names = ("stop", "value", "left", "right")
        spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), *(x[n].alias(n) for n in names)))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(_none(f"array<struct<{_ENTITY}>>"))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(BASE))))


def candidates(text: Column) -> Column:
    """Identifier-like tokens without the marks around them: (start, stop, value, left, right)."""
    text = F.coalesce(text, F.lit(""))

    def bare(x: Column) -> Column:
        head = F.length(x["value"]) - F.length(F.regexp_replace(x["value"], r"^[(\[{<\"']+", ""))
        value = F.regexp_replace(F.regexp_replace(x["value"], r"^[(\[{<\"']+", ""), r"(?<![^\p{L}\p{N}=])[^\p{L}\p{N}=]++$", "")
        start = x["start"] + head
        return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), x["left"].alias("left"), x["right"].alias("right"))

    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(found(text, TOKEN), bare), lambda x: x["value"] != "")).otherwise(_none(_FOUND))


def patterns_of(left: Column, value: Column, right: Column) -> Column:
    """The patterns in whose slot a value stands, from the text on its left and right; `_` is the slot."""
    left = F.regexp_replace(F.lower(left), r"[(\[{<\"']+$", "")
    words = F.when(left.rlike(rf"[{SPACE}]$"), F.filter(F.split(left, rf"[{SPACE}]+", -1), lambda w: w != "")).otherwise(_none("array<string>"))
    after = F.nullif(F.regexp_extract(F.lower(right), rf"^[^{SPACE}]*[{SPACE}]+([^{SPACE}]+)(?=[{SPACE}])", 1), F.lit(""))
    after = F.when(~value.rlike(rf"[{SPACE}]"), after)
    return _bound(words, lambda w: patterns_at(w, F.size(w), after))


def patterns_at(words: Column, k: Column, after: Column) -> Column:
    """The patterns of the k-th word (from 1) as the last before a slot; after is the word behind the slot, or null."""

    def word(i: Column) -> Column:
        w = F.get(words, i - 1)
        return F.when((i > 0) & (F.length(w) <= WORD_CHARS), w)

    one = F.concat(word(k), F.lit(" _"))
    two = F.concat(word(k - 1), F.lit(" "), one)
    three = F.concat(word(k - 2), F.lit(" "), two)
    around = F.concat(one, F.lit(" "), F.when(F.length(after) <= WORD_CHARS, after))
    return F.array_compact(F.array(one, two, three, around))


def shape_fits(value: Column, kind: Column) -> Column:
    """Can an unknown value be of the kind at all?"""
    digits = F.length(_digits(value))
    return (
        F.when(kind == 0, value.contains("@"))
        .when(kind == 1, value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$|^[0-9A-Fa-f]*:[0-9A-Fa-f:]*:[0-9A-Fa-f]*$"))
        .when(kind == 2, digits.between(12, 19) & value.rlike("^[0-9-]+$"))
        .when(kind == 3, digits.between(7, 15) & value.rlike(r"^[0-9().+-]+$"))
        .otherwise(value.rlike(SECRET_SHAPE))
    )


#: What tells a row's content from another's.
KEY = ["k1", "k2"]


def _key(docs: DataFrame) -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(7), "doc_id").alias("k2")]


def occurrences(based: DataFrame) -> DataFrame:
    """(KEY, start, stop, kind, value, patterns): entities, and the tokens that no entity touches, with kind null; once for equal rows."""
    base = based.select(*KEY, F.explode("entities").alias("x")).select(*KEY, "x.start", "x.stop", "x.kind", "x.value", "x.left", "x.right")
    other = based.select(*KEY, F.explode("tokens").alias("x")).select(*KEY, "x.start", "x.stop", F.lit(None).cast("int").alias("kind"), "x.value", "x.left", "x.right")
    own = Window.partitionBy(*KEY).orderBy("start")  # one text's entities and tokens
    stop = F.max(F.when(F.col("kind").isNotNull(), F.col("stop"))).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(own.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = base.unionByName(other).distinct().withColumns({"_stop": stop, "_start": start})
    free = F.col("kind").isNotNull() | ~(F.coalesce(F.col("_stop") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_start") < F.col("stop"), F.lit(False)))
    return rows.where(free).select(*KEY, "start", "stop", "kind", "value", patterns_of(F.col("left"), F.col("value"), F.col("right")).alias("patterns"))


def pattern_counts(docs: DataFrame, promising: DataFrame) -> DataFrame:
    """(pattern, times): how often each of the contexts occurs in all texts."""
    last = F.regexp_extract("pattern", rf"([^{SPACE}]+) _", 1)
    ends = promising.select(last.alias("word")).distinct()
    words = F.split(F.btrim(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(" \t\n\x0b\f\r")), rf"[{SPACE}]+", -1)
    at = lambda w, k: patterns_at(w, k, F.get(w, k + 1))
    listed = [r[0] for r in ends.limit(LITERAL_WORDS + 1).collect()]
    if len(listed) <= LITERAL_WORDS:
        here = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda k: F.get(w, k - 1).isin(listed))
        every = docs.select(F.explode(_bound(words, lambda w: F.flatten(F.transform(here(w), lambda k: at(w, k))))).alias("pattern"))
    else:
        each = _bound(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.struct(F.get(w, k - 1).alias("word"), at(w, k).alias("patterns"))))
        every = docs.select(F.inline(each)).join(ends, "word", "left_semi").select(F.explode("patterns").alias("pattern"))
    few = promising.limit(FEW + 1).count() <= FEW
    return every.join(F.broadcast(promising) if few else promising, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("times"))


def _by_kind(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges with what is known of their values, once for each kind that a pattern may stand for."""
    return edges.join(known, "value", "left").select("*", F.explode(F.array(*(F.lit(k) for k in range(len(KINDS))))).alias("as_kind"))


def _tested() -> tuple[Column, Column, Column]:
    """Is a value of the kind, may it be, or can't it?"""
    right = F.coalesce(F.col("kind") == F.col("as_kind"), F.lit(False))
    open_ = F.col("kind").isNull() & shape_fits(F.col("value"), F.col("as_kind"))
    return right, open_, ~right & ~open_


def scored(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, as_kind, confidence) of the good patterns, from edges (pattern, value, n, times) and known (value, kind, score)."""
    each = _by_kind(edges, known)
    right, open_, bad = _tested()
    scores = each.groupBy("pattern", "as_kind", "times").agg(
        F.sum(F.when(right, F.col("score")).otherwise(0.0)).alias("good"),
        F.count_if(right).alias("instances"),
        F.count_if(bad).alias("bad"),
        F.sum(F.when(right | open_, F.col("n")).otherwise(0)).alias("followed"),
    )
    confidence = F.col("good") / (F.col("instances") + F.col("bad"))
    return scores.where((F.col("instances") >= SEEDS) & (confidence >= CONFIDENCE) & (F.col("followed") >= FREQUENCY * F.col("times"))).select("pattern", "as_kind", confidence.alias("confidence"))


def discovered(docs: DataFrame, based: DataFrame) -> DataFrame | None:
    """(KEY, start, kind, stop) that the patterns add, or None."""
    occ = cut(occurrences(based))
    behind = occ.select("value", "kind", F.explode("patterns").alias("pattern"))
    secret = F.col("kind").isNull() & F.col("value").rlike(SECRET_SEED)
    of_kind = F.when(secret, F.lit(SECRET)).otherwise(F.col("kind"))
    seeds = occ.select("value", of_kind.alias("kind")).where("kind is not null").distinct()
    # a value found as two kinds counts as the first
    seeds = seeds.groupBy("value").agg(F.min("kind").alias("kind"))
    by_kind = behind.select("pattern", of_kind.alias("kind"), "value").where("kind is not null").distinct().groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    seeded = by_kind.where(F.col("seeds") >= SEEDS).select("pattern").distinct()
    edges = cut(behind.join(seeded, "pattern", "left_semi").groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n")))
    # what is wrong for a kind stays wrong: patterns that can't get right in any round needn't be counted
    right, open_, bad = _tested()
    hopeful = _by_kind(edges, seeds).groupBy("pattern", "as_kind").agg(F.count_if(right).alias("right"), F.count_if(open_).alias("open"), F.count_if(bad).alias("bad"))
    hopeful = hopeful.where((F.col("right") >= SEEDS) & (F.col("right") + F.col("open") >= CONFIDENCE * (F.col("right") + F.col("open") + F.col("bad"))))
    promising = cut(hopeful.select("pattern").distinct())
    if promising.isEmpty():
        return None
    edges = edges.join(pattern_counts(docs, promising), "pattern")
    edges = cut(edges)
    known = cut(seeds.withColumn("score", F.lit(1.0)))
    size = known.count()
    while True:
        good = cut(scored(edges, known))
        fresh = (
            edges.join(known.select("value"), "value", "left_anti")
            .join(good, "pattern")
            .where(shape_fits(F.col("value"), F.col("as_kind")))
            .groupBy("value")
            .agg(F.max(F.struct(F.col("confidence"), -F.col("as_kind"))).alias("best"))
            .select("value", (-F.col("best.col2")).alias("kind"), F.col("best.confidence").alias("score"))
        )
        known = cut(known.unionByName(fresh))
        now = known.count()
        if now == size:
            break
        size = now
    new = known.join(seeds.select("value"), "value", "left_anti").select("value", F.col("kind").alias("new_kind"))
    # keys that stand in the slot of a pattern of keys
    confirmed = edges.join(good.where(F.col("as_kind") == SECRET), "pattern").select("value").distinct()
    new = new.unionByName(seeds.where(F.col("kind") == SECRET).join(confirmed, "value", "left_semi").select("value", F.col("kind").alias("new_kind")))
    return occ.where("kind is null").join(new, "value").select(*KEY, "start", F.col("new_kind").cast("int").alias("kind"), "stop").distinct()


def _based(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_key(docs), base_entities(F.col("text")).alias("entities"), candidates(F.col("text")).alias("tokens"))


def _added(docs: DataFrame, based: DataFrame, column: str) -> DataFrame | None:
    """(KEY, column): the spans that the patterns add to rows of that content; None if there are none."""
    more = discovered(docs, based)
    if more is None:
        return None
    more = cut(more)
    n = more.limit(FEW + 1).count()
    if not n:
        return None
    more = more.groupBy(*KEY).agg(F.collect_set(F.struct("start", "kind", "stop")).alias(column))
    return F.broadcast(more) if n <= FEW else more


def _bare(entities: Column) -> Column:
    return F.transform(entities, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))


def listed(spans: Column) -> Column:
    """kind:start:stop of all spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["stop"])), ",")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of every row, arrays of (start, kind, stop) in order."""
    docs = docs.select("doc_id", "text")
    based = cut(_based(docs))
    added = _added(docs, based, "more")
    rows = based.select("doc_id", *KEY, _bare(F.col("entities")).alias("base"))
    rows = rows.withColumn("more", _none(f"array<{_SPAN}>")) if added is None else rows.join(added, KEY, "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", _none(f"array<{_SPAN}>"))))
    return rows.select("doc_id", "base", every.alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by <KIND> (and n_chars, if there, counted anew); of spans that overlap the first counts."""
    columns = docs.columns
    slim = docs.select("doc_id", "text")
    based = cut(_based(slim))
    name = unused(columns, "more")
    added = _added(slim, based, name)
    rows = docs
    every = _bare(base_entities(F.col("text")))
    if added is not None:
        keys = [unused(columns, k) for k in KEY]
        added = added.withColumnsRenamed(dict(zip(KEY, keys, strict=True)))
        rows = docs.withColumns({k: v for k, v in zip(keys, _key(docs), strict=True)}).join(added, keys, "left")
        every = F.array_sort(F.array_union(every, F.coalesce(F.col(name), _none(f"array<{_SPAN}>"))))
    names = F.array(*(F.lit(f"<{x.upper()}>") for x in KINDS), F.lit(""))

    def one(state: Column, x: Column) -> Column:
        item = F.struct(state["pos"].alias("at"), x["start"].alias("start"), F.element_at(names, x["kind"] + 1).alias("name"))
        new = F.struct(x["stop"].alias("pos"), F.concat(state["out"], F.array(item)).alias("out"))
        return F.when(x["start"] >= state["pos"], new).otherwise(F.struct(F.greatest(state["pos"], x["stop"]).alias("pos"), state["out"].alias("out")))

    def replaced(s: Column) -> Column:
        end = F.length("text").cast("long")
        s = F.concat(s, F.array(F.struct(end.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("stop"))))
        holes = _running(s, F.lit(0).cast("long"), one, "array<struct<at:bigint,start:bigint,name:string>>")
        # four bytes for each code point, so that a piece is found at once wherever it is
        piece = lambda raw, x: F.decode(F.substring(raw, (4 * x["at"] + 1).cast("int"), (4 * (x["start"] - x["at"])).cast("int")), "UTF-32")
        pieces = lambda raw: F.transform(holes, lambda x: F.concat(piece(raw, x), x["name"]))
        return F.array_join(_bound(F.encode("text", "UTF-32"), pieces), "")

    text = _bound(every, lambda s: F.when(F.size(s) == 0, F.col("text")).otherwise(replaced(s)))
    rows = rows.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found_ = spans(table(spark, sf_dir, "documents"))

    def of(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    count = [of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found_.select("doc_id", *count, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
