"""The corpus operators against brute force, and on awkward rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pellucid.llm import decontaminate_fm, flat, html_mincut, lang_rank, lm_bloom, mixing, near_dedup, pii_bootstrap, quality_rules, substring_rlz, url_markov

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats inside a text, blanks, nulls and a long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(5, 200)) for _ in range(40)]
    shared = sentence(rng, 60)
    out = list(base)
    for t in base[:12]:
        w = t.split()
        out += [t, " ".join(w[: len(w) // 2] + ["changed"] + w[len(w) // 2 + 1 :]), t.replace(" ", "\n"), t.upper()]
    out += [sentence(rng, 15) + " " + shared + "\t" + sentence(rng, 15) for _ in range(12)]
    out += [shared + " " + shared, shared, None, None, "", " \n\t", "one", "one", "one two three", "Ünïcödé " * 30, "a " * 4000 + sentence(rng, 3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 17 == 0 else f"s{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_kernels_match_plain_python(texts):
    import pyarrow as pa

    data, at = flat.buffers(pa.array(texts, pa.string()))
    starts, ends, first = flat.words(data, at, flat.WORD_BYTES)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h = flat.word_hashes(data, starts, ends)
    by_word = defaultdict(set)
    for word, x in zip((w for t in got for w in t), h.tolist()):
        by_word[word].add(x)
    assert all(len(v) == 1 for v in by_word.values()) and len({*map(min, by_word.values())}) == len(by_word)
    for w in (1, 2, 3, 13):
        want = [min(range(i, i + w), key=lambda k: (h[k], k)) for i in range(len(h) - w + 1)]
        assert flat.sliding_argmin(h, w).tolist() == want


# 1


PAGES = {
    "<html><head><title>T</title></head><body><nav><a href=x>Home</a> <a>About</a></nav><article><h1>Head &amp; tail</h1><p>First <b>bold</b>ed&nbsp;text,\n here.<p>Second.</article><footer>&copy; me</footer></body>": "Head & tail First bolded text, here. Second.",
    "<body><div id='content'><p>A long enough sentence of real text, with commas, and more words to read.</p><p>Short.</p></div><div class='sidebar'><p>A long enough sentence of other text, with commas, and more words.</p></div>": "A long enough sentence of real text, with commas, and more words to read. Short.",
    "<article><p>Kept one two three.</p><div class=\"ad\">Buy this, now, today.</div><form>Name <input> Mail</form><p>Kept too.</p><section id=comments><p>Nice post, thank you, really.</p></section></article>": "Kept one two three. Kept too.",
    "<article><p>x<script>var t='</p>';</script>y</p><style>p{}</style><!-- no --><p>z &lt;b&gt; &#228;</p></article>": "xy z <b> ä",
    "<article><p>cut off &am": "cut off &am",
    "<article><p>cut <a href='": "cut",
    "": "",
    None: "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_mincut.main_text(page) == PAGES[page]


def test_min_cut_is_least():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 8)
        source, sink = ([rng.randrange(6) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randrange(1, 5)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])

        least = min(cost([k >> i & 1 > 0 for i in range(n)]) for k in range(2**n))
        assert cost(html_mincut.min_cut(source, sink, edges)) == least


def test_html_columns(spark):
    rows = spark.createDataFrame([(1, "u", p, "old") for p in PAGES], "page_id long, url string, html string, text string")
    got = html_mincut.extracted(rows).collect()
    assert sorted(r["text"] for r in got) == sorted(PAGES.values()) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_of_table(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in html_mincut.op1_html_text(spark, data).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert r["text"] == want


# 2


def brute_base(texts, held):
    tokens = [[w.translate(UPPER) for w in WORD.findall(t or "")] + [None] for t in texts]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return n, [(len(t), sum(c[x] > 0 for x in t), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for t in tokens]


@pytest.mark.parametrize("most", [10**7, 60, 0])
def test_lm_base_is_exact(docs, texts, most):
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    d = docs.select("doc_id", "text", lm_bloom.held_out(docs["doc_id"]).alias("held_out"))
    model, sums = lm_bloom.learn(d.where("not held_out"), max_vocabulary=most)
    total, want = brute_base(texts, held)
    assert model.total == total and (model.least == 1) == (most == 10**7) and len(model.vocabulary[0]) <= most
    got = {r["doc_id"]: r for r in lm_bloom.scored(d, model, sums).collect()}
    assert len(got) == len(texts)
    for i, (n, known, base) in enumerate(want):
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"]) == (held[i], n, known)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] < 0


def test_lm_filter_holds_counts(docs, texts):
    model, _ = lm_bloom.learn(docs)
    c = Counter(x for t in texts for x in [w.translate(UPPER) for w in WORD.findall(t or "")])
    import pyarrow as pa

    words = sorted(c)
    data, at = flat.buffers(pa.array(words, pa.string()))
    starts, ends, _ = flat.words(data, at, flat.WORD_BYTES)
    level = model.filter.level(flat.word_hashes(data, starts, ends))
    want = lm_bloom.level_of(np.array([c[w] for w in words]))
    assert (level >= want).all() and (level == want).mean() > 0.9


def test_lm_scores_seen_passages_higher(docs, spark):
    model, sums = lm_bloom.learn(docs)
    rng = random.Random(5)
    seen = docs.where("doc_id = 3").first()["text"]
    words = seen.split()
    rng.shuffle(words)
    both = spark.createDataFrame([(1, seen), (2, " ".join(words))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_bloom.scored(both, model, sums).collect()}
    assert got[1] > got[2]


@pytest.mark.parametrize("most", [10**7, 60])
def test_lm_of_a_large_filter_drops_nothing(docs, monkeypatch, most):
    d = docs.select("doc_id", "text", lm_bloom.held_out(docs["doc_id"]).alias("held_out"))
    want = {r["doc_id"]: r for r in lm_bloom.scored(d, *lm_bloom.learn(d.where("not held_out"))).collect()}
    monkeypatch.setattr(lm_bloom, "CHUNK", 500, raising=False)
    got = {r["doc_id"]: r for r in lm_bloom.scored(d, *lm_bloom.learn(d.where("not held_out"), max_filter_bytes=0, max_vocabulary=most)).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (want[i]["held_out"], want[i]["n_tokens"], want[i]["n_known"])
        assert (r["base_score"], r["score"]) == (pytest.approx(want[i]["base_score"], rel=1e-9), pytest.approx(want[i]["score"], rel=1e-12))


def brute_scores(texts, training, prior=lm_bloom.PRIOR):
    """The smoothed probabilities from exact counts, quantised as the filter holds them."""
    tokens = [[w.translate(UPPER) for w in WORD.findall(t or "")] + [None] for t in texts]
    seen = [x for x, h in zip(tokens, training) if h]
    one, two = Counter(w for t in seen for w in t), Counter(p for t in seen for p in zip([0, *t], t))
    value = lambda c: float(lm_bloom.VALUES[int(lm_bloom.level_of(np.array([c]))[0])])
    below = sum(one.values()) + 0.1 * (len(one) + 1)
    out = []
    for t in tokens:
        total = 0.0
        for a, b in zip([0, *t], t):
            context = value(one[None] if a == 0 else one[a])  # there is a start for every end
            c = min(value(two[a, b]) if two[a, b] >= lm_bloom.LEAST_BIGRAM else 0.0, context)
            total += math.log10((c + prior * (value(one[b]) + 0.1) / below) / (context + prior))
        out.append(total)
    return out


@pytest.mark.parametrize("most", [None, 0])
def test_lm_score_against_brute_force(docs, texts, monkeypatch, most):
    monkeypatch.setattr(lm_bloom, "HASHES", 24)  # so that no probe errs
    training = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    limits = {} if most is None else {"max_filter_bytes": most}
    d = docs.select("doc_id", "text", lm_bloom.held_out(docs["doc_id"]).alias("held_out"), docs["n_chars"].alias("row_key"))
    model, sums = lm_bloom.learn(d.where("not held_out"), **limits)
    got = {r["doc_id"]: r for r in lm_bloom.scored(d, model, sums).collect()}
    for i, want in enumerate(brute_scores(texts, training)):
        assert got[i]["score"] == pytest.approx(want, rel=1e-9) and got[i]["row_key"] == (None if texts[i] is None else len(texts[i]))


def test_lm_scores_are_the_same_for_all_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_bloom, "FLUSH", 3000)
    d = docs.select("doc_id", "text")
    runs = []
    for n, shuffle, bound in ((1, 4, 10**8), (7, 64, 10**8), (5, 3, 0)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            runs.append({r["doc_id"]: (r["score"], r["base_score"]) for r in lm_bloom.scored(d, *lm_bloom.learn(d.repartition(n), max_filter_bytes=bound)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1] == runs[2]


def test_lm_filter_errs_as_stated(docs):
    """Of words never seen, about ERROR report a count; of those the most are one level up."""
    model, _ = lm_bloom.learn(docs)
    level = model.filter.level(np.random.default_rng(1).integers(1, 2**63, 50_000).astype(np.uint64))
    assert 0.5 * lm_bloom.ERROR < (level > 0).mean() < 1.5 * lm_bloom.ERROR
    assert (level > 1).mean() < 1.5 * lm_bloom.ERROR**2


def test_lm_of_nothing(nothing, docs):
    model, sums = lm_bloom.learn(nothing)
    assert model.total == 0
    assert all(r["n_known"] == 0 for r in lm_bloom.scored(docs.select("doc_id", "text"), model, sums).collect())
    assert lm_bloom.scored(nothing, *lm_bloom.learn(docs)).count() == 0


# 3


def brute_statistics(t):
    t = t or ""
    w, where = WORD.findall(t), defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i : i + 5])].append(i)
    covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(3)
    rows = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)]
    rows += [None, "", "\n\n a\n a \na\n a", "#*$%&|<> x", "ä\x0bö\x0cü\r" * 20, "x " * 5000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in quality_rules.statistics(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(rows[r["doc_id"]]), r


def test_rules_are_learned_and_applied(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 80, 10**6) if i % 3 else " ".join(f"w{rng.randrange(10**6)}###" for _ in range(80))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    got = quality_rules.judged(docs, rules).collect()
    assert rules and all(r["kept"] == (r["doc_id"] % 3 > 0) for r in got)
    assert quality_rules.learn(docs, labels.where("false")) == []
    assert quality_rules.judged(docs.where("false"), rules).count() == 0


def test_base_rule_of_quality(docs, texts):
    for r in quality_rules.judged(docs, []).collect():
        n, *_, repeated = brute_statistics(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n) and r["kept"] != r["base_failed"]


# 4


def brute_repeats(rows):
    seen, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        w = words[i]
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            else:
                seen[key] = (i, k)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def check_repeats(df, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_rlz.repeats_removed(df).collect()}
    assert got == brute_repeats(rows)


def test_repeats_removed(docs, texts):
    check_repeats(docs, list(enumerate(texts)))


def test_repeats_of_few_words(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for i in range(60)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    monkeypatch.setattr(substring_rlz, "FLUSH", 50)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_repeats_factors_and_edges(spark, nothing):
    rng = random.Random(2)
    a, b = sentence(rng, 50), sentence(rng, 50)
    rows = spark.createDataFrame([(2, f"x {a} {b}"), (1, b), (0, a), (None, a), (0, a)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in substring_rlz.repeats_removed(rows).collect()}
    assert [tuple(f) for f in got[2, 101]["factors"]] == [(1, 50, 0 - 2**63, 0), (51, 50, 1, 0)]
    assert got[None, 50]["n_removed"] == 0 and got[0, 50]["n_removed"] == 50
    assert substring_rlz.repeats_removed(rows).count() == 5
    assert substring_rlz.repeats_removed(nothing).count() == 0


# 5


def test_repeats_of_rows_that_share_an_id(spark):
    """Rows with one id, or none, but other texts are documents of their own; equal rows get one result."""
    rng = random.Random(14)
    own = [sentence(rng, 60, 10**6) for _ in range(6)]
    shared = sentence(rng, 30, 10**6)
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (3, own[2]), (3, own[3]), (3, own[2]), (1, f"{own[4]} {shared}"), (2, f"{shared} {own[5]}"), (3, f"x {shared}")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, doc_key long").repartition(4)
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_rlz.repeats_removed(df).collect()))
    assert got == sorted([(0, 60, 0)] * 3 + [(3, 60, 0)] * 3 + [(1, 90, 0), (2, 90, 30), (3, 31, 30)])


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check_groups(df, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(df).collect()}
    assert got == brute_groups(rows)


def test_groups(docs, texts):
    check_groups(docs, list(enumerate(texts)))


def test_groups_in_chains_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for g in range(6):
        w = sentence(rng, 120).split()
        for _ in range(25):
            w = list(w)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_groups(df, rows)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", 500)
    check_groups(df, rows)


def test_groups_of_awkward_rows(spark, nothing, docs):
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(rows).collect() if r["doc_id"] != 6)
    assert got == [(False, 5, None, False), (False, 5, None, False), (True, None, None, True)]
    assert near_dedup.groups(nothing).count() == 0
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns


def test_groups_of_rows_that_share_an_id(spark):
    """Rows without an id, or with the id of another text, link by their own texts; a group keeps one row."""
    rng = random.Random(8)
    one, two, three = (sentence(rng, 80, 5000).split() for _ in range(3))
    near = lambda w, k: " ".join([*w[:40], f"n{k}", *w[41:]])
    rows = [(None, " ".join(one)), (5, near(one, 1)), (None, " ".join(two)), (9, near(two, 2)), (7, " ".join(three)), (7, near(one, 3)), (7, " ".join(three)), (8, near(three, 4)), (7, near(three, 5))]
    rows += [(None, ""), (None, None), (11, " "), (11, " ")]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, rep long, doc_key string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near_dedup.groups(df).where("n_shingles > 0").collect())
    # texts one and two have a row without an id each, so that both groups are named by it; three has not
    assert got == sorted([(-1, -1), (5, -1), (-1, -1), (9, -1), (7, 7), (7, -1), (7, 7), (8, 7), (7, 7)])
    kept = near_dedup.kept_documents(df)
    assert kept.columns == df.columns
    kept = sorted(r["rep"] for r in kept.collect())
    assert [k for k in kept if k > 8] == [9, 10, 11, 12]
    kept = [k for k in kept if k < 9]
    assert len(kept) == 3 and {0, 2} < set(kept) and kept[-1] in (4, 6, 8)


def test_forest_finds_every_link():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.uint64) for _ in range(25)]
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in near_dedup.linked_forest(sets, 60):
            root[find(a)] = find(b)
        for i, x in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(x, sets[j]))
                if 100 * common >= 60 * (len(x) + len(sets[j]) - common):
                    assert find(i) == find(j)


# 6


BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum((x * 2 - 9 * (x > 4)) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute_spans(t):
    return sorted((m.start(), list(BASE).index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(t or "") if ok(m[0]))


PRIVATE = [
    "mail a.b+c@d-e.co.uk, x@y or q@w.e.", "a@b.c@d.e @f.g h@i..j _k@l.m_n@o.p", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5 01.002.0003.255 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 1",
    "tel +1 (375) 555-4393 +49.30.1234567 +1 2 +123456789012345678", "ÄÖ😀 +1 (375) 555-4393 x@y.zz", "1" * 3000, "+1+2+3 " * 50, "a@" * 500 + "b.c", None, "", "no data here", "x@y.zz " * 700,
]


def test_base_spans(spark):
    rng = random.Random(9)
    rows = PRIVATE + ["".join(rng.choice("a1.@+- (9ü") for _ in range(80)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for r in pii_bootstrap.spans(df).collect():
        assert [tuple(x) for x in r["base"]] == brute_spans(rows[r["doc_id"]]), rows[r["doc_id"]]
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def bootstrap_rows():
    rng = random.Random(1)
    rows = [f"{sentence(rng, 6)} hotline +1 (555) {200 + i}-{1000 + i} {sentence(rng, 6)}" for i in range(8)]
    rows += [f"{sentence(rng, 6)} hotline 555-{2000 + i:04d}, {sentence(rng, 6)}" for i in range(4)]
    rows += [f"the {sentence(rng, 4)} the version 2.0 the 555-3000 {sentence(rng, 4)}" for _ in range(6)]
    return rows


def test_patterns_discover_unseen(spark):
    rows = bootstrap_rows()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [(rows[r["doc_id"]][x["start"] : x["stop"]], x["kind"]) for x in r["spans"]] for r in pii_bootstrap.spans(df).collect()}
    for i in range(8, 12):
        assert got[i] == [(f"555-{2000 + i - 8:04d}", 3)]
    assert all(got[i] == [] for i in range(12, 18))
    literal = pii_bootstrap.LITERAL_WORDS
    pii_bootstrap.LITERAL_WORDS = 0
    try:
        again = {r["doc_id"]: [(rows[r["doc_id"]][x["start"] : x["stop"]], x["kind"]) for x in r["spans"]] for r in pii_bootstrap.spans(df).collect()}
    finally:
        pii_bootstrap.LITERAL_WORDS = literal
    assert again == got


def brute_patterns(text, start, stop):
    """The contexts of a slot, read from the whitespace words beside it."""
    before = re.sub(r"[(\[{<\"']+$", "", text[:start].lower())
    words = before.split() if before[-1:].isspace() else []
    after = re.match(r"\S*\s+(\S+)(?=\s)", text[stop:].lower())
    out = [" ".join([*words[-n:], "_"]) for n in (1, 2, 3) if len(words) >= n]
    return out + ([f"{words[-1]} _ {after[1]}"] if words and after and " " not in text[start:stop] else [])


def test_pattern_scores_against_brute_force(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30)) + "a7"
    rows = [f"{sentence(rng, 5)} api key {key()} {sentence(rng, 5)}" for _ in range(6)]
    rows += [f"{sentence(rng, 5)} api key Zz-{k}xyzabcdefgh_{k} {sentence(rng, 5)}" for k in range(3)]  # found by the pattern alone
    rows += [f"{sentence(rng, 5)} of {key()} {sentence(rng, 3)}" for _ in range(3)]  # shaped like keys, but "of" is no pattern
    rows += [f"{sentence(rng, 2)} of {sentence(rng, 8)} key {sentence(rng, 2)}" for _ in range(8)]
    rows += ["mail to a@b.de now", "mail to c@d.de now", "mail to e@f.de soon", "mail to x1@home now"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: {(rows[r["doc_id"]][x["start"] : x["stop"]], x["kind"]) for x in r["spans"]} for r in pii_bootstrap.spans(df).collect()}
    # brute force: all slots with what they hold, and all contexts of all words
    slots, times = [], Counter()
    for i, t in enumerate(rows):
        base = brute_spans(t)
        for a, k, b in base:
            slots.append((t[a:b], k, brute_patterns(t, a, b)))
        for m in re.finditer(r"\S*[0-9@]\S*", t):
            if not any(a < m.end() and m.start() < b for a, _, b in base):
                left = t[: m.start()]
                last = [x.end() for x in re.finditer(r"\S*[0-9@]\S*", left)]
                slots.append((m[0], None, brute_patterns(t[last[-1] if last else 0 :], m.start() - (last[-1] if last else 0), m.end() - (last[-1] if last else 0))))
        w = t.lower().split()
        for k in range(len(w)):
            times.update(" ".join([*w[k - n + 1 : k + 1], "_"]) for n in (1, 2, 3) if k >= n - 1)
            if k + 2 < len(w):
                times[f"{w[k]} _ {w[k + 2]}"] += 1
    hexes = re.compile(r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,128}$")
    fits = lambda v, k: {0: "@" in v, 1: bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v)), 2: False, 3: bool(re.fullmatch(r"[0-9().+-]+", v)) and 7 <= len(re.sub("[^0-9]", "", v)) <= 15, 4: len(v) >= 16 and bool(re.fullmatch(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]+", v))}[k]
    known = {v: k if k is not None else 4 for v, k, _ in slots if k is not None or hexes.match(v)}
    sure, edges = set(known), Counter((p, v) for v, _, ps in slots for p in ps)
    score, good = dict.fromkeys(known, 1.0), {}
    while True:
        size, good = len(known), {}
        for p in {p for p, _ in edges}:
            for k in range(5):
                own = [(v, n) for (q, v), n in edges.items() if q == p]
                right = [v for v, _ in own if known.get(v) == k]
                free = [v for v, _ in own if v not in known and fits(v, k)]
                bad = len(own) - len(right) - len(free)
                followed = sum(n for v, n in own if v in right or v in free)
                conf = sum(score[v] for v in right) / (len(right) + bad) if len(right) + bad else 0
                if len(right) >= 3 and conf >= 0.7 and followed >= 0.5 * times[p]:
                    good[p, k] = conf
        fresh = {}
        for (p, k), c in good.items():
            for q, v in edges:
                if q == p and v not in known and fits(v, k):
                    fresh[v] = max(fresh.get(v, (0, 0)), (c, -k))
        for v, (c, k) in fresh.items():
            known[v], score[v] = -k, c
        if len(known) == size:
            break
    add = {v: k for v, k in known.items() if v not in sure} | {v: 4 for p, v in edges if (p, 4) in good and known.get(v) == 4}
    want = {i: {(t[a:b], k) for a, k, b in brute_spans(t)} | {(v, k) for v, k in add.items() if v in t.split()} for i, t in enumerate(rows)}
    assert got == want
    assert all(got[i] for i in range(9)) and not any(got[i] for i in range(9, 20)) and got[23] == {("x1@home", 0)}


def test_rows_of_one_id_share_no_spans(spark):
    """Rows without an id, or with the same one, and rows that are there twice."""
    rows = [*bootstrap_rows(), "a quite harmless sentence without anything"]
    ids = [None if k % 2 else 3 for k in range(len(rows))]
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(zip(ids, rows))], "doc_id long, text string, more long, k1 string")
    df = df.unionByName(df.where("more = 9")).repartition(3)
    alone = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    want = {r["doc_id"]: r["text"] for r in pii_bootstrap.redacted(alone).collect()}
    got = pii_bootstrap.redacted(df).collect()
    assert len(got) == len(rows) + 1 and all(r["text"] == want[r["more"]] and r["k1"] == "x" for r in got)
    assert want[len(rows) - 1] == rows[-1] and "<PHONE>" in want[9]


def test_keys_of_the_table_are_found(spark, data):
    """Recall and precision of added spans on the driver's rows: keys behind `token =`."""
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, m.start(1)) for i, t in rows.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t) if not any(a < m.end(1) and m.start(1) < b for a, _, b in brute_spans(t))}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], x["start"]) for r in pii_bootstrap.spans(df).collect() for x in r["spans"] if x["kind"] == 4}
    assert got == want and len(want) >= 8


def test_redaction(spark, nothing):
    rows = [*PRIVATE, *bootstrap_rows()]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii_bootstrap.spans(df.select("doc_id", "text")).collect()}
    names = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<SECRET>"]
    for r in pii_bootstrap.redacted(df).collect():
        t, at, out = rows[r["doc_id"]], 0, ""
        for start, kind, stop in spans[r["doc_id"]]:
            if start >= at:
                out, at = out + t[at:start] + names[kind], stop
            at = max(at, stop)
        want = None if t is None else out + t[at:]
        assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))
    assert pii_bootstrap.spans(nothing).count() == 0 and pii_bootstrap.redacted(nothing).count() == 0


def test_op6_digest(spark, data):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii_bootstrap.op6_pii(spark, data).collect():
        spans = brute_spans(text[r["doc_id"]])
        joined = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(",")) | {""}


# 7


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for i, t in rows:
        w, hit, found = ITEM.findall((t or "").translate(UPPER)), set(), set()
        for p, own in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def exam():
    rng = random.Random(12)
    items = [(i, sentence(rng, rng.randrange(8, 40), 60)) for i in range(15)]
    items += [(20, "Two words"), (21, "one"), (22, ""), (23, None), (24, "!!!"), (25, items[0][1]), (26, "x " * 30)]
    rows = [sentence(rng, 40, 60) for _ in range(20)]
    rows += [f"{sentence(rng, 9, 60)}, {t.upper().replace(' ', '-')}; {sentence(rng, 9, 60)}" for _, t in items[:15]]
    rows += [items[3][1] + " " + items[3][1], " ".join(items[4][1].split()[2:13]), "two WORDS two words", None, "", "x " * 50, "ä one.", items[5][1].replace(" ", " ä ")]
    return list(enumerate(rows)), items


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_hits(spark, exam, block):
    rows, items = exam
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    got = decontaminate_fm.hits(df, bench, block_bytes=block).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) == (n, hit, found)


def test_hits_are_removed(spark, exam):
    rows, items = exam
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars long, extra string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    for r in decontaminate_fm.remove_hits(df, bench).collect():
        n, hit, _ = want[r["doc_id"]]
        assert len(ITEM.findall((r["text"] or "").translate(UPPER))) == n - hit and r["extra"] == "x"
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) or hit == 0
    empty = bench.where("false")
    assert all(not r["items"] for r in decontaminate_fm.hits(df, empty).collect())
    assert decontaminate_fm.hits(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 300, 40])
def test_hits_are_removed_whatever_the_blocks(spark, exam, block):
    rows, items = exam
    rng = random.Random(21)
    words = sentence(rng, 30).split()
    items = items + [(100 + k, " ".join(words[k : k + 10])) for k in range(0, 20, 5)]  # overlapping windows of several items
    rows = rows + [(1000, "before " + " ".join(words) + " after"), (1000, "same id " + items[0][1]), (None, "no id " + items[1][1]), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, 1, f"x{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long, extra string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits([(f"x{k}", t) for k, (_, t) in enumerate(rows)], items)
    got = decontaminate_fm.remove_hits(df, bench, block_bytes=block)
    assert got.columns == df.columns
    got = got.collect()
    assert sorted(r["extra"] for r in got) == sorted(want)
    for r in got:
        n, hit, _ = want[r["extra"]]
        assert len(ITEM.findall((r["text"] or "").translate(UPPER))) == n - hit
        assert hit == 0 or r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_hits_of_rows_with_the_same_id(spark, exam, block):
    _, items = exam
    rows = [(1, items[0][1]), (1, "a b c"), (None, "x y"), (None, items[1][1] + " tail"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate_fm.hits(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=block).collect()
    want = brute_hits([(k, t) for k, (_, t) in enumerate(rows)], items)
    found = [(str(r["doc_id"]), r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in got]
    assert sorted(found) == sorted((str(rows[k][0]), *w) for k, w in want.items())


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = np.append(rng.integers(0, 4, 60), 0)
        index = decontaminate_fm.FMIndex(text, 3)
        phrases = np.array([[1, 2, 0], [3, 0, 0], [1, 1, 1], [2, 3, 1]])
        length = np.array([2, 1, 3, 3])
        low, high = index.search(phrases, length)
        for p, n, a, b in zip(phrases, length, low, high):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 8


def test_language_counts():
    text = "Ab äb. Ab1"
    _, gram, count = lang_rank.counted([text])
    want = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        s = f" {w} "
        want.update(x for k in (1, 2, 3) for i in range(len(s) - k + 1) if (x := s[i : i + k]).strip())
    unpacked = {"".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0)).rstrip("\0"): c for g, c in zip(gram.tolist(), count.tolist())}
    assert unpacked == dict(want)


def test_language_held_out(spark, data):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = lang_rank.op8_language(spark, data).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, nothing, docs):
    model = lang_rank.learn(spark.createDataFrame([("en", "the cat and the dog"), ("de", "der Hund und die Katze"), (None, "x"), ("fr", None), ("zh", "语言 识别")], "lang string, text string"))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the dog"), (5, "die Katze"), (6, "识别")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_rank.judged(rows, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and [got[i][0] for i in (4, 5, 6)] == ["en", "de", "zh"]
    none = lang_rank.learn(nothing)
    assert {r["lang_pred"] for r in lang_rank.judged(rows, none).collect()} == {"und"}
    assert lang_rank.judged(nothing, model).count() == 0


# 9


def test_url_rules(spark):
    urls = {
        "http://A.com/x": ("a.com", "/x", "com/", "allow"), "https://example.com/en/1?q": ("example.com", "/en/1", "example.com/en/", "block"), "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/a#b": ("www.example.com", "/en/a", "www.example.com/en/", "allow"), "ftp://b.net/es/q": ("b.net", "/es/q", "net/es/", "block"), "http://notnet/es/": ("notnet", "/es/", None, None),
        "http://x.com": ("x.com", "", None, None), "no scheme": ("", "", None, None), "http://x.org?a://b/c": ("x.org", "", None, None), None: ("", "", None, None), "http://[::1]/y\nz": ("[::1]", "/y\nz", None, None),
    }
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_markov.judged(rows).collect():
        host, path, rule, verdict = urls[list(urls)[r["page_id"]]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_url_models_tell_apart(spark):
    rng = random.Random(3)
    name = lambda s: "".join(rng.choice(s) for _ in range(12))
    rows = [(i, f"http://{name('abcde')}.com/{name('abcde')}", ) for i in range(200)] + [(i, f"http://{name('vwxyz')}.net/es/{name('vwxyz')}") for i in range(200, 400)]
    rows += [(i, f"http://{name('abcde')}.org/{name('abcde')}") for i in range(400, 440)] + [(i, f"http://{name('vwxyz')}.org/{name('vwxyz')}") for i in range(440, 480)]
    got = {r["page_id"]: r["verdict"] for r in url_markov.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert np.mean([got[i] == "allow" for i in range(400, 440)]) > 0.9 and np.mean([got[i] == "block" for i in range(440, 480)]) > 0.9


def test_markov_is_a_distribution():
    m = url_markov.Markov.learned(["abab", "abc"])
    context, _, _ = url_markov._grams(["ab"])
    at = [c[1:2] for c in context]
    total = sum(math.exp(m.log_likelihood(at, np.array([x], np.uint64))[0]) for x in [*range(256), 301])
    assert total == pytest.approx(1, abs=1e-9)


# 10


def brute_targets(sizes, weights, total):
    target, full = [0.0] * len(sizes), set()
    left = total
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        if not free:
            return target
        w = sum(weights[i] for i in free)
        share = {i: left * weights[i] / w for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            for i in free:
                target[i] = share[i]
            return target
        for i in over:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
            full.add(i)


@pytest.mark.parametrize("rows_in_range", [4096, 3])
def test_mix(docs, texts, monkeypatch, rows_in_range):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_in_range)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in rows.items()}
    names = sorted({r["source"] for r in rows.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, r in rows.items() if r["source"] == s) for s in names}
    want = dict(zip(names, brute_targets([total[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(total.values()))))
    taken = Counter()
    assert got.keys() == rows.keys()
    for i, r in got.items():
        s = rows[i]["source"]
        assert (r["size"], r["source_size"]) == (size[i], total[s]) and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == math.floor(want[s]) for s in names)
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}


def test_mix_is_cut_in_key_order(docs):
    got = [r.asDict() for r in mixing.mix(docs, keep=["doc_id", "source", "text"]).collect()]
    by_source = defaultdict(list)
    for r in got:
        key = hashlib.md5(f"mix:{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
        by_source[r["source"]].append((key, r["size"], r["taken"], r["target"], r["source_size"]))
    for rows in by_source.values():
        epochs, rest = divmod(math.floor(rows[0][3]), max(1, rows[0][4]))
        for _, size, taken, *_ in sorted(rows):
            assert taken == epochs * size + max(0, min(size, rest))
            rest -= size


def test_mix_edges(nothing, spark):
    assert mixing.mix(nothing).count() == 0
    rows = spark.createDataFrame([(1, None, None), (None, "a b", None), (2, "a b c", "s"), (2, "a b c", "s")], "doc_id long, text string, source string")
    got = mixing.mix(rows).collect()
    assert sorted((r["size"], r["taken"] <= 2 * r["size"]) for r in got) == [(0, True), (2, True), (3, True), (3, True)]


def test_mix_of_rows_that_share_an_id(spark):
    """Reruns agree on shuffled rows, whatever their ids; equal rows share what the cut leaves them; columns of the same names stay out of the way."""
    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else 7, sentence(rng, 5 + k), "s" if k % 2 else "t") for k in range(14)] + [(7, "a b c d e", "s")] * 9
    runs = set()
    for seed in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, own string").repartition(1 + seed)
        got = mixing.mix(df, keep=df.columns)
        assert got.columns == ["doc_id", "text", "source", "own", "size", "source_size", "target", "taken"]
        got = got.collect()
        runs.add(tuple(sorted((r["doc_id"] or 0, r["text"], r["taken"]) for r in got)))
    assert len(runs) == 1
    for s in "st":
        own = [r for r in got if r["source"] == s]
        assert -9 < sum(r["taken"] for r in own) - math.floor(own[0]["target"]) <= 0
        assert len({r["taken"] for r in own if r["text"] == "a b c d e"}) <= 1


def test_mixed_texts(docs):
    """The texts of a mix have the words that mix counts, and whole epochs come before parts."""
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    got = defaultdict(dict)
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]][r["epoch"]] = r["text"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (n, size) in taken.items():
        assert sum(len(WORD.findall(t)) for t in got[i].values()) == n
        assert sorted(got[i]) == list(range(1, len(got[i]) + 1)) and all(t == texts[i] for e, t in got[i].items() if e * size <= n)
    assert any(n % size for n, size in taken.values() if size)


# awkward input and brute force for the learned parts


def test_html_of_unclosed_elements_is_linear():
    import time

    def took(n):
        page = "<div>" + "<font><b>" * n + "".join(f"<p>word {k} </i></td><li>x</li>" for k in range(n))
        start = time.perf_counter()
        assert html_mincut.blocks_of(page)
        return time.perf_counter() - start

    took(200)
    assert took(8000) < 30 * took(1000)


def test_html_where_only_the_cut_decides(spark):
    """Pages without telling tags or names: a short line among prose goes with it, one among links doesn't."""
    prose = "<p>The river rose in the night, and by morning the lower fields were under water, as the old people had said.</p>"
    links = "".join(f"<p><a href=/{k}>Go to part {k}</a></p>" for k in range(6))
    page = f"<div>{links}<p>Short line</p>{links}</div><div>{prose}<p>He waited</p>{prose}{prose}</div>"
    got = html_mincut.main_text(page)
    assert "He waited" in got and "Short line" not in got and "Go to" not in got and got.count("river") == 3
    alone = [b for b in html_mincut.blocks_of(page) if b.text in ("He waited", "Short line")]
    assert html_mincut.log_odds(alone[0]) == html_mincut.log_odds(alone[1])  # the classifier alone can't tell them apart
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_mincut.extracted(nothing).count() == 0


def test_language_of_texts_with_all_letters():
    every = "".join(chr(c) for c in range(0x110000) if chr(c).isalpha())
    texts = [every, None, *(f"wort {k} und noch eins" for k in range(2000)), every]
    group, gram, count = lang_rank.counted(texts)
    assert set(group.tolist()) == set(range(len(texts))) - {1}
    alone = lang_rank.counted(texts[7:8])
    mine = group == 7
    assert sorted(zip(gram[mine].tolist(), count[mine].tolist())) == sorted(zip(alone[1].tolist(), alone[2].tolist()))
    by_group = lang_rank.counted(texts, np.arange(len(texts)) % 3)
    assert sum(by_group[2]) == sum(count)


def brute_profile(texts):
    c = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w = f" {w} "
            c.update(w[k : k + n] for n in (1, 2, 3) for k in range(len(w) - n + 1) if w[k : k + n] != " ")
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]


def test_language_distance_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    known = [("aa", make("abcde", 40)), ("aa", make("abcdf", 30)), ("bb", make("defgh", 50)), (None, "zzz"), ("cc", make("ghijä", 20))]
    model = lang_rank.learn(spark.createDataFrame(known, "lang string, text string").repartition(3), profile=60)
    profiles = {x: brute_profile([t for y, t in known if y == x])[:60] for x in ("aa", "bb", "cc")}
    texts = [make("abcde", 9), make("defgh", 30), make("hijä", 4), "q", "", "12 34", make("acegi", 200)]
    lang, score = model.judge(texts)
    for t, got, s in zip(texts, lang, score):
        own = brute_profile([t])[:60]
        if not own:
            assert (got, s) == ("und", 0)
            continue
        far = {x: sum(abs(p.index(g) - k) if g in p else 60 for k, g in enumerate(own)) for x, p in profiles.items()}
        assert got == min(far, key=lambda x: (far[x], x)) and s == pytest.approx(1 - far[got] / (60 * len(own)))


def brute_markov(texts, text):
    """Witten-Bell, order by order, of the bytes of text and its end."""
    pad = [None] * url_markov.ORDER
    counts = defaultdict(Counter)
    for t in texts:
        x = [*pad, *t.encode(), -1]
        for i in range(url_markov.ORDER, len(x)):
            for k in range(url_markov.ORDER + 1):
                counts[tuple(x[i - k : i])][x[i]] += 1
    x, out = [*pad, *text.encode(), -1], []
    for i in range(url_markov.ORDER, len(x)):
        p = 1 / url_markov.ALPHABET
        for k in range(url_markov.ORDER + 1):
            if c := counts.get(tuple(x[i - k : i])):
                p = (c[x[i]] + len(c) * p) / (sum(c.values()) + len(c))
        out.append(math.log(p))
    return out


def test_url_ratio_and_verdict_against_brute_force(spark):
    rng = random.Random(6)
    good = [f"https://www.site{rng.randrange(30)}.org/article/{rng.randrange(99)}-story" for _ in range(60)]
    bad = [f"http://spam{rng.randrange(30)}.biz/win?cash={rng.randrange(99)}" for _ in range(60)]
    urls = [(u, "allow") for u in good] + [(u, "block") for u in bad] + [(bad[0], "block")] * 200 + [(None, "allow"), ("", "block"), ("x" * 5000, "allow")]
    judge = url_markov.learn(spark.createDataFrame(urls, "url string, label string").repartition(3), sample=40)
    sides = {}
    order = {r["url"]: r["h"] for r in spark.createDataFrame([(u,) for u in {*good, *bad, ""}], "url string").selectExpr("url", "xxhash64(url) as h").collect()}
    for name, own in (("allow", {*good}), ("block", {*bad, ""})):
        first = sorted(own, key=lambda u: (order[u], u))[:40]  # each URL once, however often it comes
        sides[name] = [u for k, u in enumerate(first) if k % 5], first[::5]
    mean = lambda u: np.mean(np.array(brute_markov(sides["allow"][0], u)) - np.array(brute_markov(sides["block"][0], u)))
    asked = ["https://www.site3.org/article/5-story", "http://spam1.biz/win?cash=1", "", "ftp://other.example/ü"]
    assert judge.ratio(asked) == pytest.approx([mean(u) for u in asked], rel=1e-6)
    assert judge.threshold == pytest.approx(url_markov.calibrated(np.array([mean(u) for u in sides["allow"][1]]), np.array([mean(u) for u in sides["block"][1]])), rel=1e-6)
    assert judge.ratio([good[0]])[0] >= judge.threshold > judge.ratio([bad[0]])[0]
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_markov.judged(pages).count() == 0


def test_rules_verdict_against_brute_force(spark, docs):
    """kept is what the list says when its conditions are tried one by one on plain numbers; clashing columns are replaced."""
    rules = [(quality_rules.Condition("n_words", False, 6.5), quality_rules.Condition("upper", False, 0.5)), (quality_rules.Condition("distinct", False, 0.3),)]
    clash = docs.select("doc_id", "text", docs["n_chars"].alias("n_words"), docs["source"].alias("kept"), docs["lang"].alias("row"))
    got = quality_rules.judged(clash, rules).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        w = WORD.findall(texts[r["doc_id"]])
        chars = sum(map(len, w))
        short = len(w) <= 6.5 and sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for x in w for c in x) / max(1, chars) <= 0.5
        same = len(set(w)) / max(1, len(w)) <= 0.3
        assert r["n_words"] == len(w) and r["kept"] == (not r["base_failed"] and not short and not same)
