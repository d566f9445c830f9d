"""Fill-in-middle frames, collocations and repeated windows against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import zstandard

from quantframe.llm import collocations, fill_in_middle, repeated_windows

SCHEMA = "doc_id bigint, text string, lang string, row string, n bigint, frames string, sets string, phrase string"


def docs_of(spark, texts, langs=("en",)):
    rows = [(i, t, langs[i % len(langs)], "x", 1, "y", "z", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- fill-in-middle

def expected_form(doc_id, text, settings=fill_in_middle.Settings()):
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", [1, 7, 4096])
def test_fill_in_middle_equals_brute_force(spark, units):
    rng = random.Random(units)
    texts = [None, "", "a", "<", "has <P> inside", "<S>", "ends with <", "<S", ">P> <M", "é你😀" * 9, "x" * 5000]
    texts += ["".join(rng.choices("ab<>PSM é你😀", k=rng.randrange(40))) for _ in range(60)]
    settings = fill_in_middle.Settings(frame_units=units)
    docs = docs_of(spark, texts).union(spark.createDataFrame([(None, "no id", None, None, None, None, None, None)] * 2, SCHEMA))
    out = fill_in_middle.fill_in_middle(fill_in_middle.seekable(docs, settings=settings), settings=settings).cache()
    whole = {(r["row"]["doc_id"], r["form"], r["output"]) for r in fill_in_middle.output_texts(out).collect()}
    rows = fill_in_middle.output_digests(out).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        i = r["row"]["doc_id"]
        text = "no id" if i is None else texts[i] or ""
        form, prefix, middle, output = expected_form(i, text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (len(text), form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (i, form, output) in whole
        assert r["row"]["row"] == (None if i is None else "x")


def test_only_frames_with_a_cut_are_opened():
    pack, opened = zstandard.ZstdCompressor().compress, []
    text = "".join(chr(97 + k % 26) for k in range(1000))
    frames, ends = fill_in_middle.pack(text, 100, pack)

    def decompress(frame):
        opened.append(frame)
        return zstandard.ZstdDecompressor().decompress(frame)

    part = list(fill_in_middle.cut_out(frames, ends, 150, 730, pack, decompress))
    assert opened == [frames[1], frames[7]] and part[1:-1] == frames[2:7]
    assert b"".join(map(zstandard.ZstdDecompressor().decompress, part)).decode() == text[150:730]
    assert list(fill_in_middle.cut_out(frames, ends, 200, 200, pack, decompress)) == []
    assert list(fill_in_middle.cut_out(frames, ends, 200, 400, pack, decompress)) == frames[2:4]


def test_fill_in_middle_of_an_empty_table(spark):
    stored = fill_in_middle.seekable(docs_of(spark, ["a"]).limit(0))
    assert fill_in_middle.output_digests(fill_in_middle.fill_in_middle(stored)).count() == 0


# --- collocations

def expected_phrases(rows, settings):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, settings.longest + 1):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= settings.least}
        held = {q for p, f in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if (q := p[i:j]) != p and 100 * f >= settings.percent * candidates[q]}
        best = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:settings.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed,percent,run_words", [(1, 100, 1 << 20), (2, 100, 64), (3, 60, 500)])
def test_collocations_equal_brute_force(spark, seed, percent, run_words):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "a\x01", "a", "ü", "Ünï", "\x00", "z\x1c"] + [f"w{i}" for i in range(8)]
    texts, langs = [], ["en", None, "", "de"]
    for _ in range(220):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(60))
        if rng.random() < 0.6:
            words[3:3] = ["New", "york", "city", "hall", "park"][:rng.choice([2, 3, 4, 5, 5, 5, 5])]
        texts.append("".join(w + rng.choice([" "] * 30 + ["\t", "  ", ". ", "\n", ",", "!? "]) for w in words))
    texts += [None, "", " \t ", ".,;", texts[0], texts[0]]
    settings = collocations.Settings(least=10, top=40, percent=percent, run_words=run_words)
    docs = docs_of(spark, texts, langs)
    got = sorted(tuple(r) for r in collocations.collocations(docs, settings).collect())
    assert got == expected_phrases([(t, langs[i % 4]) for i, t in enumerate(texts)], settings)
    assert any(r[0] == "und" for r in got) and max(len(r[2].split(" ")) for r in got) == 5


def test_a_full_bit_table_changes_nothing(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], k=80)) for _ in range(60)]
    docs = docs_of(spark, texts)
    few = collocations.Settings(least=4, least_bits=6, most_bits=6)
    many = collocations.Settings(least=4)
    assert sorted(collocations.collocations(docs, few).collect()) == sorted(collocations.collocations(docs, many).collect())


def test_open_phrases_are_carried_over_ranges():
    stream = [(("a",), 9), (("a", "b"), 5), (("a", "b", "c"), 4), (("a", "b", "d"), 5), (("b",), 7)]
    whole = list(collocations.scan((0, "en", k, n, False) for k, n in stream))
    split = list(collocations.scan(iter([
        (0, "en", ("a",), 9, False), (0, "en", ("a", "b"), 5, False), (0, "en", ("a", "b", "c"), 4, False),
        (1, "en", ("a",), 9, True), (1, "en", ("a", "b"), 5, True), (1, "en", ("a", "b", "d"), 5, False), (1, "en", ("b",), 7, False)])))
    assert ("en", ("a", "b"), 5, [9], 5) in whole and ("en", ("a", "b", "d"), 5, [9, 5], 0) in whole
    assert ("en", ("a", "b"), 5, [9], 4) in split and ("en", ("a", "b"), None, None, 5) in split
    assert ("en", ("a", "b", "d"), 5, [9, 5], 0) in split


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 123_456_789_012_345, 98_765_432_109_876_543, 234_567_890_123_456, 345_678_901_234_567
    parts = spark.createDataFrame([("en", "x y", a, [left], [right])],
                                  "lang string, phrase string, a bigint, lefts array<bigint>, rights array<bigint>")
    row = collocations.scored(parts, spark.createDataFrame([("en", n)], "lang string, n bigint")).first()
    assert row["score"] == 1000 * a * n // (left * right)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert collocations.collocations(docs_of(spark, [None, "", "a b"])).count() == 0


# --- repeated windows

def expected_kept(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[p:p + depth] for x in data for p in range(len(x) - depth + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - depth + 1):
            if seen[x[p:p + depth]] > 1:
                gone[p:p + depth] = b"\1" * depth
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def edited(rng, text):
    chars = list(text)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(chars) + 1)
        chars[at:at + rng.randrange(3)] = rng.choices("abé ", k=rng.randrange(3))
    return "".join(chars)


@pytest.mark.parametrize("seed,depth,reach,cuts,slices", [
    (1, 40, 16, (4, 1), 1 << 20), (2, 40, 33, (8, 2, 1), 64), (3, 24, 10, (1,), 50), (4, 400, 256, (32, 4, 1), 300)])
def test_repeated_windows_equal_brute_force(spark, seed, depth, reach, cuts, slices):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh é你", k=rng.randrange(1, 6 * depth))) for _ in range(25)]
    texts = [None, "", "a" * (3 * depth), "ab" * depth, "abc" * depth, "x" * (depth - 1), base[0], base[0]]
    texts += base + [edited(rng, rng.choice(base)) for _ in range(40)]
    texts += [rng.choice(base)[:depth + rng.randrange(9)] + "#" + rng.choice(base)[-depth - rng.randrange(9):] for _ in range(25)]
    texts += ["".join(rng.choices("ab", k=3 * depth)) for _ in range(6)] + [base[3] + base[4], (base[5] + "!") * 3]
    settings = repeated_windows.Settings(depth, reach, cuts, slices)
    rows = repeated_windows.remove_repeated(docs_of(spark, texts), settings=settings).collect()
    want = expected_kept(texts, depth)
    assert len(rows) == len(texts)
    for r in rows:
        i = r["row"]["doc_id"]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[i], i
        assert r["kept_sha256"] == hashlib.sha256(want[i][3]).hexdigest()
    assert any(0 < w[1] < w[0] for w in want)


def test_repeated_windows_of_rows_without_id_and_of_an_empty_table(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdef", k=900))
    rows = spark.createDataFrame([(None, text), (None, text), (7, text[:500]), (7, None)], "doc_id bigint, text string")
    got = sorted(r["n_removed"] for r in repeated_windows.remove_repeated(rows).collect())
    assert got == [0, 500, 900, 900]
    assert repeated_windows.remove_repeated(docs_of(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeated_windows.Settings(depth=100, reach=94)
