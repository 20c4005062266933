"""Conversation repair, spelling variants and packing against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pellucid.llm import conversation_repair as repair
from pellucid.llm import packing, spelling

SPACES = " \t\n\x0b\x0c\r"


# conversation repair


def brute_repair(kinds):
    """The cheapest edits of (initial, gone, cut) and the least string of them, over all edit strings up to a length."""
    best = None
    wanted = re.compile(r"(s?(ua)+)?")

    def tries(i, out, letters, cost):
        nonlocal best
        if cost > 3 * len(kinds) + 4 or len(letters) > len(kinds) + 4 or best is not None and cost > best[0]:
            return
        if i == len(kinds) and wanted.fullmatch(out):
            best = min(best, (cost, letters)) if best else (cost, letters)
        if i < len(kinds):
            initial, gone, cut = kinds[i]
            tries(i + 1, out, letters + "D", cost + 3)
            if not gone:
                tries(i + 1, out + initial, letters + "K", cost + cut)
                for r in "ua":
                    tries(i + 1, out + r, letters + "R", cost + 2 + cut)
        if letters[-2:] != "II":
            for r in "ua":
                tries(i, out + r, letters + "I", cost + 2)

    tries(0, "", "", 0)
    return best


def test_cheapest_edits_against_all_edit_strings():
    rng = random.Random(3)
    cases = [()] + [tuple(rng.choice("suaoSUAOx") for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(25)] + [(a, b) for a in "suaoUx" for b in "suaAx"]
    for case in cases:
        kinds = [("o" if c == "x" else c.lower(), c == "x", int(c.isupper())) for c in case]
        assert repair.repair("".join(case)) == brute_repair(kinds), case


def brute_conversation(rows):
    """The result of one conversation of (conv_id, turn, role, text), straight from the rules."""
    after = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        after += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, faults = set(), [], Counter()
    for _, role, text in after:
        blank, again = not text.strip(SPACES), (role, text) in seen
        seen.add((role, text))
        cut = not blank and not again and text.rstrip(SPACES)[-1] not in ".!?"
        faults.update(blank=blank, duplicate=again and not blank, truncated=cut)
        kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "o", blank or again, int(cut)))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    turns = {r[0] for r in after if r[0] is not None}
    symbols = "".join("x" if gone else k.upper() if cut else k for k, gone, cut in kinds)
    cost, audit = repair.repair(symbols)  # held against all edit strings above
    out, i, last = [], 0, ""
    for letter in audit:
        if letter == "K":
            out.append(f"{after[i][1]}:{after[i][2]}")
            last = after[i][1][:1]
        elif letter != "D":
            name = "assistant" if last == "u" else "user"
            out.append(f"{name}:{after[i][2] if letter == 'R' else ''}")
            last = name[:1]
        i += letter != "I"
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, int(faults["blank"]), int(faults["duplicate"]), int(faults["truncated"]), illegal, cost, audit, digest)


def messages(rng, conv, n):
    said = ["Yes.", "no", "", " \t", "Why?", "Go on.", "A\nB!", "é ü.", None]
    out = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
        out.append((conv, None if rng.random() < 0.05 else t + (t > 3) * 2, role, rng.choice(said) if rng.random() < 0.5 else f"message {rng.randrange(10**6)}" + rng.choice([".", "!", " "])))
    return out


def as_tuples(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_repairs_against_brute_force(spark, parts):
    """Many short conversations and one that lies in all parts; nulls, repeated rows, equal turns, clashing columns."""
    rng = random.Random(8)
    rows = [r for c in range(60) for r in messages(rng, c, rng.randrange(1, 9))] + messages(rng, 1000, 400) + messages(rng, None, 5)
    rows += rows[5:9] * 2 + [(61, 4, "user", "Same."), (61, 4, "assistant", "Same."), (61, None, None, None)]
    rows += [(c, 0, "user", "Only.") for c in range(70, 110)]  # some lose their only message
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, k int, AUDIT string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = as_tuples(repair.repairs(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert len(got) == len(by)
    for conv, own in by.items():
        assert got[conv] == brute_conversation(own), conv
    assert any(x[6] == "" and x[7] == hashlib.sha256(b"").hexdigest() for x in got.values())


def test_repairs_of_text_ids_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho."), ("", 0, "user", "Hi."), (None, 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    got = as_tuples(repair.repairs(df))
    assert set(got) == {"a", "", None} and all(got[c] == brute_conversation([tuple(r) for r in df.collect() if r[0] == c]) for c in got)
    assert repair.repairs(df.where("false")).count() == 0


# spelling variants


def damaged_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = damaged_words(rows)
    beside = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, own in beside.items():
        top = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(beside[w]), words.get(form[w]))
    return out


def texts_of_variants(rng, letters, n_words):
    """Words and their misspellings, of very different counts; long words, accents and capitals."""
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 13))) for _ in range(n_words)]
    words += ["x" * 30 + "yz", "x" * 31 + "yz", "x" * 30 + "yy", "a" * 5, "a" * 6, "a" * 7, "ÀÉÎÕÜ", "àéîõü", "aaab" * 30, "aaab" * 30 + "c"]
    said = []
    for w in words:
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(w))
            v = rng.choice([w, w, w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w.capitalize()])
            said += [v] * rng.choice([1, 3, 4, 9])
    said += ["chainaa"] * 4 + ["chainab"] * 12 + ["chainbb"] * 50
    rng.shuffle(said)
    return said


@pytest.mark.parametrize(("heavy", "shard_rows"), [(4096, 16384), (6, 40)])
def test_variants_against_brute_force(spark, heavy, shard_rows):
    """Whole, and with segments refined as far as they go in many shards."""
    rng = random.Random(heavy)
    said = texts_of_variants(rng, "abéd", 260)
    rows = [(None if k % 11 == 0 else k % 25, rng.choice([" ", ", ", "-", "1", "œ"]).join(said[k * 20 : k * 20 + 20])) for k in range(len(said) // 20 + 1)] + [(3, None), (4, ""), (5, "12 ß? ×÷ "), (None, None)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, N int").repartition(4)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, heavy, shard_rows).collect()}
    assert got == brute_variants(rows)
    assert got["chainaa"][:2] == ("chainab", "chainbb")


def test_refined_segments_hold_few(spark):
    """Words that share their first half all meet; refined, no segment that can be is met by more than the bound."""
    rng = random.Random(1)
    words = {"abcdef" + "".join(rng.choice("ghij") for _ in range(6)) for _ in range(600)}
    counted = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long").cache()
    rows = spelling.segments(counted, 60)
    assert rows.where("b - a > 1").groupBy("k").count().agg({"count": "max"}).first()[0] <= 60
    assert spelling.segments(counted, 10**6).groupBy("k").count().agg({"count": "max"}).first()[0] >= 500
    got = {r["word"]: r["n_near"] for r in spelling.neighbours(counted, 60, 100).collect()}
    assert got == {w: n for w in words if (n := sum(near(w, x) for x in words))}


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(40)] + [("v", "w17")], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w40"}


# packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return packing.vocabulary_at(path), t


def test_encoder_matches_the_tokenizer(tokenizer):
    vocabulary, t = tokenizer
    own = packing.Encoder(vocabulary)
    rng = random.Random(4)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\n\n  b\t c", "  x  y", "I'm we'll 'S", "x" * 5000 + " " + "1" * 3000, " " * 5000 + "z", "\n" * 3000, "<|endoftext|> in a text", "日本語 テキスト 🙂🙂  end", "\x1c \x85 a"]
    texts += ["".join(rng.choice("ab '.,\n\t1é  日") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_first_fit_against_a_scan():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 50, 333):
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        room, placed = [], []
        for k, size in enumerate(sizes):
            b = next((i for i, r in enumerate(room) if r >= size), len(room))
            if b == len(room):
                room.append(100)
                placed.append([])
            room[b] -= size
            placed[b].append(k)
        assert packing.first_fit(sizes, 100) == (placed, [100 - r for r in room])


def test_packed_sequences_hold_all_without_padding():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 400):
        sizes = [rng.randrange(1, 64) for _ in range(n)]
        held = packing.packed(sizes, 64)
        pieces = sorted(p for own in held for p in own)
        for k, size in enumerate(sizes):
            at = 0
            for _, start, m in (p for p in pieces if p[0] == k):
                assert start == at and m > 0
                at += m
            assert at == size
        loads = [sum(m for *_, m in own) for own in held]
        assert all(x == 64 or x & (x - 1) == 0 for x in loads) and sum(x < 64 for x in loads) <= 6


def test_pieces_against_the_tokenizer(spark, tokenizer):
    """Every id once, checksums of the ids themselves, offsets without gaps; the same pieces whatever the partitions."""
    vocabulary, t = tokenizer
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["word", "Wört", "12", "a\nb", "…"]) for _ in range(rng.randrange(0, 900))) for _ in range(90)] + [None, "", "one " * 5000] + ["same text"] * 40
    rows = [(None if k % 10 == 0 else k // 2, x) for k, x in enumerate(texts)]
    runs = []
    for n in (1, 4):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, GROUP string").repartition(n)
        runs.append([tuple(r) for r in packing.pack(df, vocabulary, group_docs=30).collect()])
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, len(t.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    by_doc, by_sequence = Counter(), defaultdict(list)
    ids = {}
    for doc_id, text in rows:
        own = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault((doc_id, len(own)), []).append(own)
    for doc_id, start, length, crc, total, sequence, offset in runs[0]:
        by_doc[doc_id, total] += length
        by_sequence[sequence].append((offset, length))
        assert any(zlib.crc32(x[start : start + length].tobytes()) == crc for x in ids[doc_id, total])
    assert by_doc == {k: k[1] * n for k, n in want.items()}
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    alone = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(rows)], "doc_id long, text string")
    first, second = ({tuple(r) for r in packing.pack(alone.repartition(n), vocabulary, group_docs=30).collect()} for n in (1, 5))
    assert first == second


def test_packing_of_nothing_and_of_text_ids(spark, tokenizer):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer[0]).count() == 0
    got = packing.pack(spark.createDataFrame([("a", "x"), (None, None)], "doc_id string, text string"), tokenizer[0]).collect()
    assert sorted((r["doc_id"] or "", r["length"], r["doc_tokens"]) for r in got) == [("", 1, 1), ("a", 2, 2)]
