"""Text operators on small tables: brute force, round trips, held-out labels and awkward rows."""

import hashlib
import itertools
import os
import random
import sys
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import corpus_pipeline
from check_oracle import canonical
from quantframe.llm import (
    bpe, components, decontamination, html_blocks, html_extraction, language_model, near_dedup, quality_classifier,
    quality_rules, queries, sql, token_files, toxicity, url_filter)
from quantframe.llm.common import fold_of
from quantframe.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double, items string, k1 int"


def prose(n, seed, words=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


LONG = prose(60_000, 9, 5000)
AWKWARD = [
    (1, None, None, None, None, "a", 1.0, "x", 1), (2, "", "en", "s", 0, None, None, None, None),
    (3, " \t\n ", "en", None, 4, "a", 1.0, "x", 1), (4, "One", "en", "s", 3, "a", 1.0, "x", 1),
    (5, "One two", "en", "s", 7, "a", 1.0, "x", 1), (6, LONG, None, "s", 1, "a", 1.0, "x", 1),
    (7, prose(80, 1), "en", "s", 1, "a", 1.0, "x", 1), (7, prose(80, 1), "en", "s", 1, "a", 1.0, "x", 1),
    (None, prose(80, 1), "en", "s", 1, "a", 1.0, "x", 1), (8, prose(80, 1), "en", "s", 1, "a", 1.0, "x", 1),
    (9, prose(90, 2) + " <|endoftext|> Ünï cödé 你好 á", "de", "t", 1, "a", 1.0, "x", 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# --- quality rules

def base_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    inside = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "a b c", "a b c a b c", "a a a a", "a a a a a", "x\ny\nx\n\n \nx ", "é#|<> \x0b\x0c\r z"]
    texts += ["".join(rng.choices("ab \n#", k=rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    got = by_id(quality_rules.quality_report(df))
    for i, t in enumerate(texts):
        want = base_counts(t)
        assert tuple(got[i][c] for c in quality_rules.BASE) == want
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_rules_awkward_rows(awkward, nothing):
    rows = quality_rules.apply_quality_rules(awkward).collect()
    assert len(rows) == len(AWKWARD)
    kept = sorted(r["row"]["doc_id"] or 0 for r in rows if r["_verdict"]["kept"])
    assert kept == [0, 6, 7, 7, 8, 9]
    assert quality_rules.apply_quality_rules(nothing).count() == 0


def test_sketches_merge_to_the_same_limits(spark):
    df = quality_rules.with_stats(spark.createDataFrame([(prose(60 + i, i),) for i in range(60)], "text string"))
    at = F.lit("en"), F.lit("s")
    rules = quality_rules.Rules(min_group=10)
    whole = quality_rules.sketches(df, *at, rules)
    halves = [quality_rules.sketches(df.filter(F.xxhash64("text") % 2 == k), *at, rules) for k in (0, 1, -1)]
    merged = halves[0].union(halves[1]).union(halves[2])
    assert quality_rules.thresholds(whole, rules).collect() == quality_rules.thresholds(merged, rules).collect()


@needs_data
@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    got = canonical(queries.registered()[name](spark, SF_DIR).toPandas())
    assert got.equals(canonical(db.execute(sql.statements()[name]).fetchdf()))


# --- trained scores

def marked(spark, bad, n=240):
    """Documents whose label follows from a planted sign, and their labels."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        words = prose(60, i).split()
        if i % 4 == 0:
            for at in rng.sample(range(60), 5):
                words[at] = bad(rng)
        rows.append((i, " ".join(words), int(i % 4 != 0), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_classifier_learns_and_holds_out(spark, awkward, nothing):
    docs, labels = marked(spark, lambda r: "$$$")
    held = fold_of("doc_id", 4) == 2
    weights = quality_classifier.fit(docs, labels, training=~held)
    got = by_id(quality_classifier.score(docs, weights).select("row.doc_id", "score"))
    assert all((r["score"] >= 0.7) == (i % 4 != 0) for i, r in got.items())
    assert np.array_equal(weights, quality_classifier.fit(docs.repartition(5), labels, training=~held))
    odd = quality_classifier.score(awkward, weights).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.score(nothing, weights).count() == 0
    flat = quality_classifier.fit(docs, labels.filter("false"))
    assert {r["score"] for r in quality_classifier.score(docs, flat).collect()} == {0.5}


def test_segments_equal_brute_force():
    rng = np.random.default_rng(3)

    def best(values, lo, hi):
        """Recursive definition: the best run, then left and right of it."""
        runs = [(sum(values[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = max(runs, default=(0,))
        if top[0] <= 0:
            return []
        a = -top[2]
        b = a - top[1]
        return best(values, lo, a) + [(a, b)] + best(values, b, hi)

    for _ in range(200):
        scores = np.where(rng.random(14) < 0.4, rng.integers(1, 50, 14) / 7 + rng.random(14) / 100, 0.0)
        want = best((scores - 1.3).tolist(), 0, 14)
        got = toxicity.segments(scores, 1.3)
        assert [x[:2] for x in got] == want


def test_toxicity_learns_and_finds_passages(spark, awkward, nothing):
    docs, labels = marked(spark, lambda r: r.choice(["scoundrel", "villain"]))
    model = toxicity.fit(docs, labels, training=fold_of("doc_id", 5) != 0)
    got = by_id(toxicity.score(docs, model).select("row.doc_id", "score", "passages"))
    assert all((r["score"] >= 0.5) == (i % 4 == 0) for i, r in got.items())
    assert all(r["passages"] for i, r in got.items() if i % 4 == 0)
    assert toxicity.score(awkward, model).filter("score < 0.5").count() == len(AWKWARD)
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, blank).filter("score >= 0.5").count() == 0


# --- token ids

def test_bpe_equals_the_library(vocabulary):
    library, encoder = Tokenizer.from_file(PATH), bpe.TextEncoder(vocabulary)
    rng = random.Random(5)
    near = "abcdehilnorst'é  \n1.,!AÉ世Ὼ́‍ \x85İΣ|<>"
    far = [chr(c) for c in range(32, 0x2fff)]
    texts = [t or "" for _, t, *_ in AWKWARD] + ["aaaaaaaaa bbbb", "<|startoftext|>x<|ENDOFTEXT|>", "don't 'RE'll ΑΣΣ Σ"]
    texts += ["".join(rng.choices(near, k=rng.randrange(50))) for _ in range(600)]
    texts += ["".join(rng.choices(far, k=rng.randrange(15))) for _ in range(600)]
    for t in texts:
        cut = encoder.chunks([t.encode()])[0]
        assert np.frombuffer(b"".join([encoder.known[c] for c in cut]), np.int32).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_digests_and_decoding(spark, awkward, nothing, vocabulary):
    library = Tokenizer.from_file(PATH)
    rows = bpe.digests(awkward, vocabulary).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        ids = library.encode(r["row"]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(awkward, vocabulary).select("row.doc_id", "row.text", "ids"), vocabulary)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in decoded.collect())
    assert bpe.digests(nothing, vocabulary).count() == 0
    rows = [(1, [5, 6]), (2, None), (3, []), (4, list(range(300, 340))), (5, [7]), (6, None), (7, [8, 9, 10])] * 9
    ids = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    for block in (1, 3, 50, 1 << 20):
        got = bpe.decode(ids, vocabulary, block=block).collect()
        assert len(got) == len(rows)
        assert all(r["decoded"] == (None if r["ids"] is None else library.decode(r["ids"], skip_special_tokens=False)) for r in got)


def test_digests_take_one_python_step(awkward):
    done = bpe.digests(awkward, bpe.Vocabulary.read(PATH))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_packed_ids_round_trip():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 49_000, 5001).astype(np.uint32),
                rng.zipf(1.3, 4002).clip(max=10**6).astype(np.uint32), np.arange(70_000, dtype=np.uint32)):
        assert np.array_equal(token_files.unpack(len(ids), *token_files.pack(ids)), ids)


def test_token_files(spark, awkward, nothing):
    library = Tokenizer.from_file(PATH)
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(awkward, path, PATH, block_ids=100)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [r[0] for r in order]
    start = 0
    for r, (_, text, *_) in zip(rows, order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["ids"]) == (start, ids)
        start += len(ids)
    crc = by_id(token_files.token_file_digest(spark, path))
    assert crc[2]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())
    empty = scratch_path(spark, "tokens")
    token_files.write_token_files(nothing, empty, PATH)
    assert token_files.read_token_files(spark, empty).count() == 0


# --- pages

def test_blocks_of_untidy_pages():
    page = ("<head><title>t</title></head><body><p>One &amp; two<p>three<br>four<ul><li>a<li>b</ul><!-- no --><script>if (a < b) "
            "'</p>'</script>5 < 6<div>x</div></b></p>tail")
    assert [b.text for b in html_blocks.parse(page)] == ["One & two", "three four", "a", "b", "5 < 6", "x", "tail"]
    assert [b.text for b in html_blocks.parse("plain")] == ["plain"]
    assert html_blocks.parse("") == [] and html_blocks.parse("<!-- open <p>x") == []
    assert html_blocks.parse("<script>never closed") == []


def test_viterbi_equals_all_labellings():
    model = html_extraction.fit(pages=60, passes=30)
    extractor = html_extraction.Extractor(model)
    for page in html_extraction.training_pages(40, seed=9):
        blocks = html_blocks.parse(page)[:9]
        scores = [extractor._score(b, i, len(blocks)) for i, b in enumerate(blocks)]

        def total(labels, scores=scores):
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(
                model.pairs[a, b] for a, b in itertools.pairwise(labels))

        if blocks:
            best = max(total(y) for y in itertools.product((0, 1), repeat=len(blocks)))
            assert total(extractor.labels(blocks)) == pytest.approx(best)


def test_extraction_on_unseen_pages_and_awkward_rows(spark):
    extractor = html_extraction.Extractor(html_extraction.fit())
    wrong = total = 0
    for page in html_extraction.training_pages(150, seed=77):
        blocks = html_blocks.parse(page)
        for got, block in zip(extractor.labels(blocks) if blocks else [], blocks, strict=True):
            total += 1
            wrong += got != html_extraction.is_main(block)
    assert wrong / total < 0.03
    page = "<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One  two &eacute;.</p></article><footer>&copy; y</footer>"
    df = spark.createDataFrame([(1, page, "a"), (1, page, "a"), (2, None, None), (3, "", "b")], "page_id bigint, html string, text string")
    rows = [(r["row"]["page_id"], r["text"], r["n_chars"]) for r in html_extraction.extract(df).collect()]
    assert sorted(rows) == [(1, "T\nOne two é.", 12), (1, "T\nOne two é.", 12), (2, "", 0), (3, "", 0)]
    assert html_extraction.extract(df.limit(0)).count() == 0


# --- lists

def test_url_lists_over_time(spark):
    entries = spark.sql("""SELECT * FROM VALUES ('l','host','bad.com','add',1), ('l','host','bad.com','remove',5),
      ('l','host','bad.com','remove',6), ('l','host','bad.com','add',6), ('l','prefix','x.com/a','add',2), ('ok','host','good.bad.com','add',1),
      ('l','host',NULL,'add',1), ('l','what','x.com','add',1), ('l','host','y.com','what',1) AS t(list,kind,pattern,action,ts)""")
    captures = spark.sql("""SELECT * FROM VALUES (1,'http://bad.com/',0),(2,'http://BAD.com:80/x',1),(3,'https://u@sub.bad.com?q',4),
      (4,'http://bad.com',5),(5,'http://bad.com',6),(6,'http://x.com/a',2),(7,'http://x.com/ab',2),(8,'http://x.com/a/b?c',3),
      (9,'http://good.bad.com/',3),(10,NULL,3),(11,'nonsense',3),(12,'http://bad.com',NULL),(13,'http://notbad.com',3),
      (2,'http://BAD.com:80/x',1) AS t(id,url,fetched_at)""")
    got = by_id(url_filter.filter_urls(captures, entries, "id", allowing=("ok",)), "id")
    assert sorted(i for i, r in got.items() if r["blocked"]) == [2, 3, 5, 6, 8]
    assert got[9]["lists"] == ["l", "ok"] and len(got) == 13
    assert url_filter.filter_urls(captures, entries.limit(0), "id").filter("blocked").count() == 0
    assert url_filter.filter_urls(captures.limit(0), entries, "id").count() == 0


def test_every_capture_has_its_own_verdict(spark):
    entries = spark.sql("SELECT * FROM VALUES ('l','host','bad.com','add',1) AS t(list,kind,pattern,action,ts)")
    captures = spark.createDataFrame([(1, "http://bad.com/x", 2), (1, "http://good.com/", 2), (None, "http://bad.com/y", 2),
                                      (1, "http://bad.com/x", 0), (2, None, 2), (3, "http://bad.com/" + "a/" * 3000, 9)],
                                     "lists bigint, url string, fetched_at int")
    rows = url_filter.filter_urls(captures, entries, "lists").collect()
    assert sorted((str(r["lists"]), r["blocked"]) for r in rows) == [
        ("1", False), ("1", False), ("1", True), ("2", False), ("3", True), ("None", True)]
    assert sorted(len(r["lists_"]) for r in rows) == [0, 0, 0, 1, 1, 1]


def test_text_in_unusual_elements_is_a_block():
    page = ("<article><p>Start.</p><noscript><p>kept text here.</p></noscript><object>prose &amp; more</object>"
            "<div><canvas>drawn <p>after all</p></div></article><script>no</script><p>End" + " long" * 50_000 + "</p>")
    texts = [b.text for b in html_blocks.parse(page)]
    assert texts[:4] == ["Start.", "kept text here.", "prose & more", "drawn"] and texts[4] == "after all"
    assert "no" not in texts and texts[-1].startswith("End long") and len(texts[-1]) == 3 + 5 * 50_000


def test_ftrl_equals_the_update_rule_one_weight_at_a_time():
    settings = quality_classifier.Settings(bits=10)
    hasher, rng = quality_classifier.Hasher(10), random.Random(4)
    rows = [(*hasher((prose(30, i, 40) + " #" * (i % 3)).encode()), rng.randrange(2)) for i in range(60)]
    rows = [(i, v, y) for i, v, y in rows if len(set(i.tolist())) == len(i)]
    z, n = [0.0] * 1024, [0.0] * 1024

    def weight(k):
        if abs(z[k]) <= settings.l1:
            return 0.0
        sign = 1 if z[k] > 0 else -1
        return -(z[k] - sign * settings.l1) / ((settings.beta + n[k] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(2):
        for index, value, y in rows:
            at = [(int(k), float(v)) for k, v in zip(index, value, strict=True)]
            own = {k: weight(k) for k, _ in at}
            p = 1 / (1 + np.exp(-sum(own[k] * v for k, v in at)))
            for k, v in at:
                g = (p - y) * v
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / settings.alpha * own[k]
                n[k] += g * g
    got = quality_classifier.train_ftrl(rows, settings, 2)
    assert len(rows) > 20 and np.allclose(got, [weight(k) for k in range(1024)], atol=1e-6) and np.count_nonzero(got) > 10


def test_features_are_the_log_counts_of_hashed_ngrams():
    hasher = quality_classifier.Hasher(20)
    index, value = hasher(b"Alpha beta beta, alpha beta")
    once, twice = hasher(b"beta")[0], hasher(b"alpha beta")[0]
    assert index[0] == 0 and value[0] == 1.0 and abs((value[1:] ** 2).sum() - 1) < 1e-6
    found = dict(zip(index.tolist()[1:], value.tolist()[1:], strict=True))
    scale = max(found.values()) / np.log1p(max(np.round(np.expm1(np.array(list(found.values()))), 0).max(), 1))
    word = [k for k in once.tolist()[1:] if k in found]
    assert word and set(once.tolist()[1:]) & set(twice.tolist()[1:])
    assert all(found[k] > 0 for k in word) and scale > 0


# --- overlaps

def test_every_two_substitutions_in_thirteen_words_hit():
    words = np.arange(1, 14, dtype=np.uint64)
    hashes = set(decontamination.seeds(words)[0].tolist())
    for gone in itertools.combinations(range(13), 2):
        other = words.copy()
        other[list(gone)] += 1000
        assert hashes & set(decontamination.seeds(other)[0].tolist())


def test_decontamination(spark, awkward, nothing):
    items = {1: prose(30, 100), 2: prose(15, 101), 3: "too few words", 4: None, 5: prose(30, 100)}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    words = items[1].split()
    changed = [w if i not in (6, 13) else "new" for i, w in enumerate(words)]
    texts = {1: prose(50, 1) + " " + items[1].upper() + "! " + prose(50, 2), 2: prose(40, 3) + " " + " ".join(changed),
             3: prose(200, 4), 4: " ".join(words[:9]) + " " + prose(30, 5), 5: None, 6: "", 7: items[2],
             8: "too few words", 9: LONG + " " + " ".join(words[5:18])}
    docs = spark.createDataFrame([(i, t, "k") for i, t in [*texts.items(), (1, texts[1])]], "doc_id bigint, text string, item string")
    rows = decontamination.decontaminate(docs, bench).collect()
    found = {r["row"]["doc_id"]: r["items"] for r in rows}
    assert found == {1: [1, 5], 2: [1, 5], 3: [], 4: [], 5: [], 6: [], 7: [2], 8: [], 9: [1, 5]} and len(rows) == 10
    assert decontamination.decontaminate(awkward, bench).count() == len(AWKWARD)
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_short_items_with_substitutions(spark):
    settings = decontamination.Settings()
    for n, gone in ((10, 1), (15, 2), (15, 3), (16, 3), (20, 4)):
        item = np.arange(1, n + 1, dtype=np.uint64)
        for places in itertools.combinations(range(n), gone):
            doc = item.copy()
            doc[list(places)] += 1000
            assert decontamination.overlap(doc, item, [0], settings) >= min(12, -(-8 * n // 10))
            assert decontamination.overlap(doc[:8], item, [0], settings) == (8 if n == 10 and places[-1] > 7 else 0)
    items = {1: prose(15, 400), 2: prose(6, 401)}
    words = [w if i not in (1, 13) else "new" for i, w in enumerate(items[1].split())]
    docs = {1: f"{prose(40, 402)} {' '.join(words)} {prose(40, 403)}", 2: f"x {items[2]} y", 3: "x " + items[2][:-3]}
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    rows = decontamination.decontaminate(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), bench).collect()
    assert {r["row"]["doc_id"]: r["items"] for r in rows} == {1: [1], 2: [2], 3: []}


def test_decontamination_equals_all_pairs(spark):
    rng = random.Random(21)
    items = {k: prose(rng.choice([6, 14, 20, 40]), 600 + k, 5000).split() for k in range(12)}
    items[12] = items[3][:]  # the same item under another id
    docs = {}
    for k in range(60):
        words = prose(rng.randrange(5, 120), 700 + k, 5000).split()
        for _ in range(rng.randrange(3)):
            own = list(items[rng.randrange(12)])
            if len(own) > 14:
                for at in rng.sample(range(len(own)), rng.randrange(3)):
                    own[at] = "changed"
                own = own[:rng.randrange(10, len(own) + 1)]
            words[len(words) // 2:len(words) // 2] = own
        docs[k] = words
    settings, words_of = decontamination.Settings(), decontamination.Words()
    want = {}
    for k, words in docs.items():
        doc = words_of(" ".join(words).encode())
        found = {}
        for i, own in items.items():
            item = words_of(" ".join(own).encode())
            found[i] = decontamination.overlap(doc, item, range(-len(item), len(doc) + 1), settings)
        want[k] = (sorted(i for i, n in found.items() if n), max(found.values()))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {r["row"]["doc_id"]: (sorted(r["items"]), r["overlap_words"] or 0) for r in decontamination.decontaminate(table, bench).collect()}
    assert got == want
    assert sum(bool(i) for i, _ in want.values()) > 20 and any(not i for i, _ in want.values())


# --- near duplicates

def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[i] = frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and sets[b]:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies():
    rng = random.Random(8)
    rows = []
    base = prose(120, 50, 3000).split()
    for i in range(90):  # a large group around one text, many of its pairs below the threshold
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 9)):
            words[at] = f"z{rng.randrange(10**6)}"
        rows.append(" ".join(words))
    passage = prose(40, 51, 3000)
    rows += [prose(60, 200 + i, 3000) + " " + passage for i in range(60)]  # one passage in many texts
    rows += [rows[3]] * 25 + [rows[95].upper()] * 3 + ["", None, "  ", "a", "A", "a b", "a b c", "a b"]
    for i in range(20):  # chains
        words = prose(100, 300 + i // 5, 3000).split()
        rows.append(" ".join(words[(i % 5) * 3:]))
    return list(enumerate(rows))


@pytest.mark.parametrize("width, percent, few", [(3, 85, 256), (5, 80, 16), (3, 85, 2), (5, 80, 2)])
def test_components_equal_brute_force(spark, width, percent, few):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    settings = near_dedup.Settings(width=width, percent=percent, few=few)
    got = by_id(near_dedup.near_duplicates(docs, settings=settings))
    want = brute_components(rows, width, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_linked_sets_share_the_tokens_that_differences_ask_for():
    rng = np.random.default_rng(3)
    tried = dict.fromkeys((near_dedup.AROUND, near_dedup.BESIDE, near_dedup.AWAY), 0)
    for turn in range(3000):
        percent = (80, 85)[turn % 2]
        pivot = rng.choice(2000, rng.integers(3, 150), replace=False)

        def changed(base, most):
            gone = rng.random(len(base)) < rng.random() * most
            return np.unique(np.append(base[~gone], rng.integers(0, 4000, int(rng.random() * most * len(base)))))

        x = changed(pivot, (0.25, 0.5, 1.5)[turn % 3])
        y = changed(x, 0.2)
        common = len(np.intersect1d(x, y))
        if min(len(x), len(y)) == 0 or np.array_equal(x, y) or 100 * common < percent * (len(x) + len(y) - common):
            continue
        p = np.sort(pivot)
        if np.array_equal(x, p) or np.array_equal(y, p):
            continue
        of_x, of_y = ({k: (linked, set(t.tolist()), need) for k, linked, t, need in near_dedup.differences(z, p, percent)} for z in (x, y))
        both = [k for k in of_x if k in of_y and (k != near_dedup.BESIDE or of_x[k][0] != of_y[k][0])]
        if not both:
            assert of_x.keys() == of_y.keys() == {near_dedup.BESIDE}  # both are linked with the pivot
        for k in both:
            tried[k] += 1
            shared = len(of_x[k][1] & of_y[k][1])
            assert shared >= of_x[k][2] and shared >= of_y[k][2]
    assert min(tried.values()) > 20


def test_unrelated_changes_of_a_text_make_no_pairs(spark):
    rng = random.Random(31)
    base = prose(200, 60, 3000).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for at in rng.sample(range(200), 18):
            words[at] = f"q{rng.randrange(10**7)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"{rows[7][1]} tail{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    settings = near_dedup.Settings(width=3, percent=85)
    seen = []

    def watched(pairs, *args):
        seen.append(pairs.count())
        return collided(pairs, *args)

    collided, near_dedup._collided = near_dedup._collided, watched
    try:
        got = by_id(near_dedup.near_duplicates(docs, settings=settings))
    finally:
        near_dedup._collided = collided
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, 3, 85)
    assert seen[-1] < 400  # of 80,000 pairs


def test_sketches_never_tell_linked_sets_apart():
    rng = np.random.default_rng(8)
    for turn in range(2000):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000)), dtype=np.uint64))
        y = np.unique(np.append(x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 300)), dtype=np.uint64)))
        bits = sum(int(w & 0xFFFFFFFFFFFFFFFF).bit_count() for w in
                   (near_dedup.parity_sketch(x) ^ near_dedup.parity_sketch(y)).tolist())
        apart, common = len(np.setxor1d(x, y)), len(np.intersect1d(x, y))
        assert bits <= apart
        percent = (80, 85)[turn % 2]
        if common * 100 >= percent * (len(x) + len(y) - common):
            assert bits * (100 + percent) <= (len(x) + len(y)) * (100 - percent)


def test_changes_of_the_same_words_make_few_pairs(spark):
    rng = random.Random(37)
    base = prose(200, 61, 3000).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for at in rng.sample(range(0, 200, 2), 18):
            words[at] = f"q{at}x{rng.randrange(2)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, f"{rows[7][1]} tail{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    settings, seen = near_dedup.Settings(width=3, percent=85), []

    def watched(*args):
        pairs = meeting(*args)
        seen.append(pairs.count())
        return pairs

    meeting, near_dedup._meeting = near_dedup._meeting, watched
    try:
        got = by_id(near_dedup.near_duplicates(docs, settings=settings))
    finally:
        near_dedup._meeting = meeting
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, 3, 85)
    assert seen[-1] < 400  # of 80,000 pairs


def test_differences_are_met_without_pivots(spark, monkeypatch):
    rows = [(0, 0, t, i, 1, False) for i in range(4) for t in (1, 2, 3 + i)]
    postings = spark.createDataFrame(rows, "pivot bigint, kind int, token bigint, id bigint, need bigint, linked boolean")
    steps, materialize = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: (steps.append(name), materialize(df, name))[1])
    met = near_dedup._prefix(postings, ["pivot", "kind"], pivots=False)
    assert "pivot_of" not in met.columns and "pivots" not in steps
    assert sorted(r["id"] for r in met.collect()) == [0, 1, 2, 3]  # tokens 1 and 2 have the same members


def test_rows_of_one_id_with_other_texts_are_other_documents(spark):
    a, b, c = prose(80, 71), prose(80, 72), prose(80, 73)
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, a, "x"), (3, c, "x"), (4, b + " end", "x"), (None, a, "x"), (5, None, "x"), (5, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect() if r["doc_id"])
    assert got == [(1, 76, 1, True)] * 3 + [(2, 76, 1, False), (3, 76, 3, True), (4, 77, 1, False), (5, 0, 5, True), (5, 0, 5, True)]
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in near_dedup.drop_near_duplicates(docs).collect())))
    assert kept == sorted(map(str, [(1, a), (1, b), (3, c), (None, a), (5, None)]))


def test_near_dedup_awkward_rows(awkward, nothing):
    kept = near_dedup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert near_dedup.near_duplicates(awkward).count() == len(AWKWARD)
    assert near_dedup.drop_near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    found = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


# --- language model

def test_model_counts_equal_brute_force(spark, awkward, nothing):
    settings = language_model.Settings(words=10, local_words=20, draws=2000, rounds=1, shards=2)
    docs = awkward.select("doc_id", "text")
    model, counts = language_model.fit(docs, F.coalesce(F.col("doc_id"), F.lit(0)) != 9, settings=settings)
    rows = language_model.score(awkward, model, counts, settings=settings).collect()
    train = [(r[1] or "").encode().lower().split() + [None] for r in AWKWARD if r[0] != 9]
    count = {}
    for t in itertools.chain.from_iterable(train):
        count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    assert model.tokens == n and len(rows) == len(AWKWARD)
    for r in rows:
        tokens = (r["row"]["text"] or "").encode().lower().split() + [None]
        base = sum(np.log10((count.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(tokens)
        assert r["n_known"] == sum(t in count for t in tokens) and r["score"] < 0
    empty, none = language_model.fit(nothing, settings=settings)
    assert empty.tokens == 0 and language_model.score(awkward, empty, none, settings=settings).filter("n_known > 0").count() == 0


def test_probabilities_add_up_and_training_helps():
    settings = language_model.Settings(words=6, size=8, draws=40_000, batch=256)
    rng = np.random.default_rng(1)
    v = settings.outputs
    ids = [0]
    for _ in range(20_000):  # a token is mostly the one before plus one
        ids.append((ids[-1] + 1) % v if rng.random() < 0.8 else int(rng.integers(v)))
    keys, counts = np.unique(language_model._keys(np.array(ids), v), return_counts=True)
    unigram = np.bincount(ids, minlength=v) / len(ids)
    params = language_model.new_params(unigram, settings)
    before = language_model.log_table(params)
    for turn in range(3):
        params = language_model.train_shard(keys, counts, params, unigram, settings, turn)
    after = language_model.log_table(params)
    assert np.allclose(np.exp(after).sum(axis=2), 1, atol=1e-4)
    assert after.reshape(-1)[keys] @ counts > before.reshape(-1)[keys] @ counts + 0.5 * counts.sum()


def test_vocabulary_follows_the_corpus(spark):
    rng = random.Random(12)
    pairs = [f"a{i} b{i}" for i in range(300)] * 25  # 600 words, each second one follows from the one before
    rng.shuffle(pairs)
    docs = spark.createDataFrame([(i, " ".join(pairs[i::150])) for i in range(150)], "doc_id bigint, text string")
    settings = language_model.Settings(draws=40_000)
    model, counts = language_model.fit(docs, settings=settings)
    assert len(model.words) == 600 and model.other_tokens == 0
    rows = language_model.score(docs, model, counts, settings=settings).collect()
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.5  # half of the words are certain, worth up to 1.2 each


def test_training_covers_every_token(spark):
    settings = language_model.Settings(words=300, size=8, draws=50)
    ids = np.arange(4000) % 300 + 1
    keys, counts = np.unique(language_model._keys(ids, settings.outputs), return_counts=True)
    unigram = (np.bincount(ids, minlength=settings.outputs) + 0.5) / (len(ids) + 0.5 * settings.outputs)
    params = language_model.new_params(unigram, settings)
    done = language_model.train_shard(keys, counts, params, unigram, settings, 1)
    assert (done["context"] != params["context"])[1:301].any(axis=1).all()
    contexts = spark.createDataFrame([(7, 3 * language_model.PART + 5), (8, 2)], "key bigint, n bigint")
    rows = language_model._dealt(contexts, 50).collect()
    assert sum(r["n"] for r in rows if r["key"] == 7) == 3 * language_model.PART + 5
    assert len(rows) == 5 and len({r["shard"] for r in rows if r["key"] == 7}) > 1


def test_training_holds_one_number_per_token():
    settings = language_model.Settings(words=300, size=8, draws=1)
    rng = np.random.default_rng(5)
    v, n = settings.outputs, 400_000
    keys = np.unique(rng.integers(0, v ** 3, n))
    unigram = np.full(v, 1 / v)
    params = language_model.new_params(unigram, settings)
    tracemalloc.start()
    try:
        language_model.train_shard(keys, np.ones(len(keys), dtype=np.int64), params, unigram, settings, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * n


def test_shards_hold_all_keys_and_shuffle_packed_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(c)) for k, c in zip(rng.integers(0, 500, 5000), rng.integers(1, 9000, 5000), strict=True)]
    contexts = spark.createDataFrame(rows, "key bigint, n bigint").repartition(3)
    dealt = language_model._dealt(contexts, 4).localCheckpoint()
    want = {(r["shard"], r["key"]): r["n"] for r in dealt.groupBy("shard", "key").agg(F.sum("n").alias("n")).collect()}
    table = language_model._shard_table(dealt)
    got = {(r["number"], k): n for r in table.collect() for k, n in zip(*(x.tolist() for x in language_model._unpacked(r["data"])), strict=True)}
    assert got == want and table.count() == 4


def test_merging_a_shard_holds_little():
    rng = np.random.default_rng(7)
    n = 600_000
    parts = []
    for _ in range(30):
        keys, counts = np.unique(rng.integers(0, 10 ** 9, n // 30), return_counts=True)
        parts.append(language_model._packed(keys, counts))
    keys, counts = (np.concatenate(x) for x in zip(*map(language_model._unpacked, parts), strict=True))
    tracemalloc.start()
    try:
        data = language_model._merged(parts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want, back = np.unique(keys, return_inverse=True)
    got, times = language_model._unpacked(data)
    assert got.tolist() == want.tolist() and times.tolist() == np.bincount(back, counts).astype(int).tolist()
    assert peak < 45 * n
    met = language_model._met(np.array([5, 7, 26]), np.array([2, 1, 4]), np.array([0, 1, 3]))
    assert met["output"].tolist() == [0, 1, 6] and met["context"].tolist() == [3, 2, 9]


def test_a_training_step_equals_the_plain_formula():
    settings = language_model.Settings(words=40, size=6, noise=5, batch=1000)
    rng = np.random.default_rng(8)
    v = settings.outputs
    keys = rng.zipf(1.3, (3, 900)).clip(1, v).astype(np.int64) - 1
    keys = (keys[0] * v + keys[1]) * v + keys[2]
    unigram = rng.random(v)
    unigram /= unigram.sum()
    params = language_model.new_params(unigram, settings)
    params["place"] = rng.random(params["place"].shape).astype(np.float32)
    got = language_model._train(keys.copy(), params, unigram, settings, 3)
    draw, edges = np.random.default_rng(3), params["edges"]
    draw.shuffle(keys)
    token, one, two = keys % v, keys // v % v, keys // v // v
    r1, r2 = params["context"][one].astype(float), params["context"][two].astype(float)
    h = np.column_stack([r1 * params["place"][0] + r2 * params["place"][1], np.ones(len(keys))])
    grads = {k: np.zeros(x.shape) for k, x in params.items() if k != "edges"}
    d_h = 0
    for name, share, right in (("output", unigram, token), ("classes", np.add.reduceat(unigram, edges[:-1]), np.searchsorted(edges, token, side="right") - 1)):
        upto = np.cumsum(share) / share.sum()
        noise = np.minimum(np.searchsorted(upto, draw.random(settings.noise), side="right"), len(upto) - 1)
        q, base = params[name].astype(float), np.log(settings.noise * share)
        a = 1 / (1 + np.exp((h * q[right]).sum(axis=1) - base[right]))
        b = -1 / (1 + np.exp(-(h @ q[noise].T - base[noise])))
        np.add.at(grads[name], right, a[:, None] * h)
        np.add.at(grads[name], noise, b.T @ h)
        d_h = d_h + (a[:, None] * q[right] + b @ q[noise])[:, :-1]
    np.add.at(grads["context"], one, d_h * params["place"][0])
    np.add.at(grads["context"], two, d_h * params["place"][1])
    grads["place"] += np.stack([(d_h * r1).sum(axis=0), (d_h * r2).sum(axis=0)])
    for name, g in grads.items():
        want = params[name] + settings.rate * g / np.sqrt(1e-3 + g * g)
        assert np.allclose(got[name][:, :want.shape[1]], want, atol=2e-4), name


def test_runs_of_all_lengths_are_added_up():
    rng = np.random.default_rng(9)
    for n, kinds in ((1, 1), (10, 1), (3000, 30), (3000, 2000), (6, 6), (7, 1), (8, 2)):
        rows, grad = rng.integers(0, kinds, n), rng.normal(size=(n, 5)).astype(np.float32)
        order, first, distinct, at = language_model._grouped(rows)
        assert distinct.tolist() == np.unique(rows).tolist() and (distinct[at] == rows).all()
        want = np.zeros((kinds, 5))
        np.add.at(want, rows, grad)
        assert np.allclose(language_model._sums(grad[order], first), want[distinct], atol=1e-4)


def test_shards_of_a_task_send_their_changes_once():
    class Shared:
        pass

    settings = language_model.Settings(words=30, size=4, draws=1)
    rng = np.random.default_rng(10)
    v = settings.outputs
    unigram = np.full(v, 1 / v)
    shared = Shared()
    shared.value = params = language_model.new_params(unigram, settings)
    shards = [np.unique(rng.integers(0, v ** 3, 400), return_counts=True) for _ in range(5)]
    batch = pa.RecordBatch.from_pydict({"number": pa.array(range(5), pa.int32()), "tokens": [int(s[1].sum()) for s in shards], "data": pa.array([language_model._packed(*s) for s in shards], pa.binary())})
    run = language_model._round(shared, unigram, settings, 0)
    together = pa.Table.from_batches(run([batch])).to_pylist()
    apart = [r for i in range(5) for r in pa.Table.from_batches(run([batch.slice(i, 1)])).to_pylist()]
    assert len(apart) == 20 and sorted(r["name"] for r in together) == ["classes", "context", "output", "place"]
    for r in together:
        parts = [p for p in apart if p["name"] == r["name"]]
        schema = pa.schema({"name": pa.string(), "block": pa.int32(), "rows": pa.binary(), "weight": pa.binary(), "change": pa.binary()})
        want, = language_model._average(pa.Table.from_pylist(parts, schema)).to_pylist()
        assert want["rows"] == r["rows"]
        assert np.allclose(np.frombuffer(want["change"], np.float16), np.frombuffer(r["change"], np.float16), atol=2e-3)


def test_a_shard_comes_in_small_rows(spark, monkeypatch):
    settings = language_model.Settings(words=30, draws=5000)
    keys, n = np.unique(np.random.default_rng(11).integers(0, settings.outputs ** 3, 900), return_counts=True)
    edges, size = np.array([0, 4, settings.outputs]), len(language_model._packed(keys, n))
    monkeypatch.setattr(language_model, "PIECE", 100)
    parts = [language_model._packed(keys[a:a + 350], n[a:a + 350]) for a in range(0, len(keys), 350)]
    rows = [(language_model._packed(keys[a:a + 100], n[a:a + 100])) for a in range(0, len(keys), 100)]
    merged = language_model._merged_keys(parts)
    assert (merged[0] == keys).all() and (merged[1] == n).all() and max(map(len, rows)) < size / 4
    batches = [pa.RecordBatch.from_pydict({"number": pa.array([i], pa.int32()), "tokens": [int(n.sum())], "data": pa.array([r], pa.binary())})
               for i in (3, 4) for r in rows]
    shards = list(language_model._shards(iter(batches), edges, settings))
    assert [s.number for s in shards] == [3, 4]
    for s in shards:
        assert sorted(s.drawn[:s.filled]) == sorted(language_model._drawn(keys, n, settings)) and s.filled == len(s.drawn)
        assert all((x == s.met[k]).all() for k, x in language_model._met(keys, n, edges).items() if k != "place")


def test_counted_contexts_are_dealt_by_the_task(spark):
    texts = ["a b a b c"] * 3000 + [f"w{i} x{i}" for i in range(500)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = (b"a", b"b", b"c")
    ids = [language_model._keys(language_model._ids(language_model.words_of((t or "").encode()), {b"a": 1, b"b": 2, b"c": 3}, 4), 5) for t in texts]
    packed = language_model.count_contexts(docs, "text", words, 5, 4)
    assert packed.columns == ["shard", "data"] and packed.count() <= 3 * 4
    table = language_model._merged_shards(packed).collect()
    got = {}
    for r in table:
        for k, n in zip(*(x.tolist() for x in language_model._unpacked(r["data"])), strict=True):
            got[k] = got.get(k, 0) + n
    keys, n = np.unique(np.concatenate(ids), return_counts=True)
    assert got == dict(zip(keys.tolist(), n.tolist(), strict=True))
    keys, n, shard = language_model._dealt_keys(np.array([5, 7, 9]), np.array([1, 3 * language_model.PART + 5, 17]), 50, 2)
    assert n[keys == 7].tolist() == [language_model.PART] * 3 + [5] and len(set(shard[keys == 7].tolist())) > 1


def test_equal_tokens_are_trained_as_one_row():
    settings = language_model.Settings(words=40, size=6, noise=5, batch=9000)
    rng = np.random.default_rng(12)
    v = settings.outputs
    keys, n = np.unique(rng.zipf(1.2, 3000).clip(1, v ** 3) - 1, return_counts=True)
    drawn = np.repeat(keys, n)
    keys, times = language_model._together(drawn)
    assert (np.repeat(keys, times) == drawn).all() and times.max() == language_model.TOGETHER and len(keys) < len(drawn) * 0.7
    unigram = rng.random(v)
    unigram /= unigram.sum()
    params = language_model.new_params(unigram, settings)
    got = language_model._train(keys, params, unigram, settings, 3, times)
    # one step over all tokens by the plain formula, with the noise that is drawn for that many rows
    draw = np.random.default_rng(3)
    draw.shuffle(np.empty(len(keys)))
    token, one, two = drawn % v, drawn // v % v, drawn // v // v
    h = np.column_stack([params["context"][one].astype(float) + params["context"][two], np.ones(len(drawn))])
    d_h, classes = 0, np.searchsorted(params["edges"], token, side="right") - 1
    for name, share, right in (("output", unigram, token), ("classes", np.add.reduceat(unigram, params["edges"][:-1]), classes)):
        noise = np.minimum(np.searchsorted(np.cumsum(share) / share.sum(), draw.random(settings.noise), side="right"), len(share) - 1)
        q, base, g = params[name].astype(float), np.log(settings.noise * share), np.zeros(params[name].shape)
        a = 1 / (1 + np.exp((h * q[right]).sum(axis=1) - base[right]))
        b = -1 / (1 + np.exp(-(h @ q[noise].T - base[noise])))
        np.add.at(g, right, a[:, None] * h)
        np.add.at(g, noise, b.T @ h)
        d_h = d_h + (a[:, None] * q[right] + b @ q[noise])[:, :-1]
        want = params[name] + settings.rate * g / np.sqrt(1e-3 + g * g)
        assert np.allclose(got[name][:, :want.shape[1]], want, atol=2e-3), name
    g = np.zeros(params["context"].shape)
    np.add.at(g, one, d_h)
    np.add.at(g, two, d_h)
    assert np.allclose(got["context"][:, :settings.size], params["context"] + settings.rate * g / np.sqrt(1e-3 + g * g), atol=2e-3)


def test_words_of_many_texts_are_those_of_each(spark):
    texts = ["", " a", "A b  C ", None, "\t\nx\x0by\x0cz\r", "Ünï Ä\u00a0b \x1c c\u2003d", "you 你好 A", " " * 5, "one"]
    words, sizes = language_model.split_words(pa.array(texts * 2).slice(1, 12))
    want = [language_model.words_of((t or "").encode()) for t in (texts * 2)[1:13]]
    assert words.to_pylist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    known = sorted(set(words.to_pylist()))[::2]
    places = language_model.word_places(words, pa.array(known, pa.binary()))
    assert places.tolist() == [known.index(w) if w in known else len(known) for w in words.to_pylist()]
    ids = [language_model._ids(w, {k: i for i, k in enumerate(known, 1)}, len(known) + 1) for w in want]
    keys = np.concatenate([language_model._keys(i, len(known) + 2) for i in ids])
    assert (language_model._text_keys(places + 1, sizes, len(known) + 2) == keys).all()
    odd = spark.sql("select cast(X'61ff2062' as string) t union all select 'a b'")  # not UTF-8
    assert {bytes(r["word"]): r["n"] for r in language_model.count_words(odd, "t").collect()} == {b"a\xff": 1, b"a": 1, b"b": 2}


def test_shared_parts_give_the_plain_softmax():
    rng = np.random.default_rng(13)
    settings = language_model.Settings(words=60, size=8)
    v = settings.outputs
    unigram = rng.random(v) + 0.01
    for scale in (1, 8, 60):  # the largest leaves the range of 32 bits
        params = language_model.new_params(unigram / unigram.sum(), settings)
        params["context"] *= 10 * scale
        keys = np.unique(rng.zipf(1.1, 9000).clip(1, v ** 3) - 1)
        params64 = {k: x if k == "edges" else x.astype(float) for k, x in params.items()}
        h = np.column_stack([params64["context"][keys // v % v] + params64["context"][keys // v // v], np.ones(len(keys))])
        group = np.searchsorted(params["edges"], keys % v, side="right") - 1
        classes, outputs = h @ params64["classes"].T, h @ params64["output"].T
        inside = np.repeat(np.arange(len(params["edges"]) - 1), np.diff(params["edges"]))[None] == group[:, None]
        want = classes[np.arange(len(keys)), group] - np.logaddexp.reduce(classes, axis=1)
        want += outputs[np.arange(len(keys)), keys % v] - np.logaddexp.reduce(np.where(inside, outputs, -np.inf), axis=1)
        assert np.allclose(language_model.log_probs(params, keys), want, rtol=1e-4, atol=1e-4)


def test_word_hashes_are_those_of_spark(spark):
    words = [b"", b"a", "wörter".encode(), b"x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w binary").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(language_model.word_hash(bytes(r["w"])) == r["h"] for r in rows)


# --- pipeline

@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        before = docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "decontamination", "bpe"]


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in queries.registered() if n not in sql.statements()))
def test_queries_give_a_row_per_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert queries.registered()[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


@needs_data
def test_pipeline_on_awkward_and_empty_tables(spark, awkward, nothing):
    good = prose(120, 90, 3000)
    more = [(20, good, "en", "s", 1, "a", 1.0, "x", 1), (21, good + " tail", "en", "s", 1, "a", 1.0, "x", 1), (20, prose(120, 91, 3000), "en", "s", 1, "a", 1.0, "x", 1),
            (None, prose(120, 92, 3000), None, None, None, None, None, None, None)]
    docs = awkward.union(spark.createDataFrame(more, SCHEMA))
    for table, some in ((docs, True), (nothing, False)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, SF_DIR)
            assert out.columns == table.columns, name
            rows = out.collect()
            assert set(map(tuple, rows)) <= set(map(tuple, kept.collect())), name
            kept = spark.createDataFrame(rows, table.schema)
        done = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR).collect()
        assert len(done) == kept.count() and bool(done) is some
        left = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
        if some:
            # both texts of id 20 stay, of the near copies one; LONG has no copy
            assert [t for i, t in left if i == 20] == sorted([good, more[2][1]]) and not any(i == 21 for i, _ in left)
            assert any(t == LONG for _, t in left) and any(t == more[3][1] for _, t in left)
            assert all(r["n_tokens"] == len(r["ids"]) for r in done)
