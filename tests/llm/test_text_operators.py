"""Tokenizers, line rules and classifiers against libraries, brute force and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparrel.llm import bpe, language, lines, quality, queries, token_counts, toxicity
from sparrel.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = ["a", "b", "s", "'s", "'ll", "''", " ", "  ", "\n", "\t", "1", "22", "½", "é", "Σ", "ς", "İ", "!", "...", "<|endoftext|>", "<|endoftext", "日本", "́", "​", "\x85", "\xa0", "\x1c", "😀", "hello", "The", " world", "don't", "I'd", "\r\n", "<|startoftext|>"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*made, "", None, " ", "\n", "word " * 40_000, None, "The same", "The same"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # extra columns with names that operators use themselves
    return spark.createDataFrame([(k if k % 50 else None, t, "src1", "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, source string, id string, host int").repartition(3)


def test_bpe_equals_the_library(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    want = collections.Counter((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids)
    got = collections.Counter(tuple(r)[1:] for r in bpe.round_trip(docs, path).collect())
    assert got == want
    listed = collections.Counter(tuple(r["ids"]) for r in bpe.encode(docs, path).collect())
    assert listed == collections.Counter(map(tuple, ids))
    back = collections.Counter(r["text"] for r in bpe.decode(bpe.encode(docs, path), path).collect())
    assert back == collections.Counter(t or "" for t in texts)


def test_bpe_of_foreign_ids(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, [15496, None, 10**6]), (2, None), (3, [])], "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in bpe.decode(rows, path).collect()} == {1: "Hello", 2: "", 3: ""}


def test_token_counts_equal_the_library(docs, texts):
    path = queries.tokenizer("word_bpe_49k.json")
    library = token_counts.library(path)
    want = collections.Counter((len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for t in texts)
    for size in (0, 5000):
        got = token_counts.count_tokens(docs, path, 2048, table_size=size).collect()
        assert collections.Counter(tuple(r)[1:] for r in got) == want


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    marked = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_line_measures(spark, docs, texts):
    rng = random.Random(5)
    more = ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, *more]], "text string").select(F.lit(1).alias("doc_id"), "text", F.lit(None).cast("string").alias("source"))
    got = collections.Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in lines.measures(rows).collect())
    assert got == collections.Counter(map(brute_measures, [*texts, *more]))


def test_line_frequency(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    filler = lambda k: " ".join(f"{name(k)}x{name(j)}" for j in range(30))
    rows = [(k, f"Menu  item {k}\n" + filler(k), "h1") for k in range(8)]  # one boilerplate line by digits
    rows += [(100, "menu item 5\n" + "menu item 9 " * 0 + filler(100), "h2")]  # rare on its own host
    rows += [(200 + k, "alpha " * 3 + " ".join(f"q{name(j)}" for j in range(40)) + f"\nown {name(k)}", "h3") for k in range(8)]  # depleted: the long line is in all
    rows += [(300 + k, "copied " + filler(300), "h3") for k in range(20)]  # copies of one text count once
    rows += [(400, None, "h1"), (401, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["id"]: r for r in lines.quality_rules(docs, least=5, texts=True).collect()}
    assert all(got[k]["removed_words"] == 3 and got[k]["kept"] for k in range(8))
    assert got[100]["removed_words"] == 0
    assert not any(got[200 + k]["kept"] or got[200 + k]["base_failed"] for k in range(8))
    assert all(got[300 + k]["kept"] for k in range(20))
    assert got[400]["base_failed"] and got[401]["n_words"] == 0
    kept = {r["doc_id"]: r["text"] for r in lines.apply_rules(docs, least=5, texts=True).collect()}
    assert set(kept) == {*range(8), 100, *range(300, 320)}
    assert kept[3] == filler(3) and kept[100].startswith("menu item 5")


def test_line_limit_is_the_same_on_every_large_host(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    filler = lambda k: " ".join(f"{name(k)}x{name(j)}" for j in range(30))
    long, middle, short = "seven words that stand in each page", "five words in each page", "to top"

    def page(k):  # the lines stand in 40 texts of each host, however many it has
        return "\n".join([long, middle, short, filler(k)]) if k % 1000 < 40 else filler(k)

    rows = [(k, page(k), "hot") for k in range(1000)] + [(1000 + k, page(1000 + k), "small") for k in range(40)]
    rows += [(1500 + k, filler(1500 + k), "small") for k in range(60)]  # 100 documents: half of them are above all limits but that of short lines
    rows += [(2000 + k, f"{long}\n{middle}\n{filler(2000 + k)}" if k < 15 else filler(2000 + k), "tiny") for k in range(50)]  # above the limit of long lines only
    rows += [(3000 + k, f"{long}\n{filler(3000 + k)}" if k < 10 else filler(3000 + k), "rare") for k in range(30)]  # at the limit
    rows += [(4000 + k, f"{short}\n{filler(4000 + k)}" if k < 101 else filler(4000 + k), "short") for k in range(250)]
    rows += [(5000 + k, f"{short}\n{filler(5000 + k)}\n{short}\n{short}" if k < 40 else filler(5000 + k), "repeated") for k in range(80)]  # three copies are no long line
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["id"]: r["removed_words"] for r in lines.quality_rules(docs).collect()}
    assert all(got[k] == got[1000 + k] == 12 for k in range(40)) and not any(got[k] for k in range(40, 1000))
    assert all(got[2000 + k] == 7 for k in range(15)) and not any(got[3000 + k] for k in range(10))
    assert all(got[4000 + k] == 2 for k in range(101))
    assert not any(got[5000 + k] for k in range(40))
    kept = {r["doc_id"]: r["text"] for r in lines.apply_rules(docs).collect()}
    assert kept[3] == f"{short}\n{filler(3)}" and kept[2003] == f"{middle}\n{filler(2003)}" and kept[3003].startswith(long)


def test_line_limit_on_small_hosts_and_documents_counted(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    filler = lambda k: " ".join(f"{name(k)}x{name(j)}" for j in range(30))
    rows = [(k, f"read more\n{filler(k)}", "eight") for k in range(6)] + [(k, filler(k), "eight") for k in (6, 7)]
    rows += [(10 + k, f"read more\n{filler(10 + k)}", "four") for k in range(4)]
    rows += [(20 + k, f"read more\n{filler(20)}", "copies") for k in range(12)] + [(20, f"read more\n{filler(20)}", "copies")] * 3  # repeated rows are one document
    rows += [(40, f"read more\n{filler(40)}", "rows")] * 12 + [(41, filler(41), "rows")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for some in (docs, docs.distinct()):
        got = {r["id"]: (r["removed_words"], r["kept"]) for r in lines.quality_rules(some).collect()}
        assert all(got[k] == (2, True) for k in range(6)) and got[6] == (0, True)
        assert all(got[10 + k] == (0, True) for k in range(4)) and got[40] == (0, True)
        assert all(got[20 + k] == (32, False) for k in range(12))  # all lines of twelve documents that are copies
        by_text = {r["id"]: r["removed_words"] for r in lines.quality_rules(some, texts=True).collect()}
        assert not any(by_text[20 + k] for k in range(12)) and by_text[3] == 2


def test_line_removal_equals_counting(spark):
    """Against plain Python, with NULLs, repeated rows and ties at the limits."""
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 5, 6, 9, 12) for _ in range(4)]
    rows = []
    for k in range(400):
        own = "\n".join([" ".join(f"w{rng.randrange(10**6)}z" for _ in range(rng.randint(5, 30))), *rng.sample(pool, rng.randint(0, 6))])
        rows.append((rng.choice([k, k, None]), rng.choice([own, own, own, None, ""]) if k % 9 == 0 else own, rng.choice(["h1", "h1", "h2", None, "h3"])))
    rows += rows[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip()
    held, size, all_docs = collections.defaultdict(set), {}, collections.defaultdict(set)
    for i, t, h in rows:
        all_docs[h or ""].add((i, t or ""))
        for line in (t or "").split("\n"):
            if WORD.search(line):
                held[h or "", norm(line)].add((i, t or ""))
                size[norm(line)] = len(line.split())
    limit = lambda h, x: min(50 if size[x] <= 2 else 5 if size[x] >= 6 else 10, max(4, len(all_docs[h]) / 2))
    gone = {k for k, d in held.items() if len(d) > limit(*k)}
    want = collections.Counter((i, sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (h or "", norm(x)) in gone)) for i, t, h in rows)
    assert collections.Counter((r["id"], r["removed_words"]) for r in lines.quality_rules(docs, least=10).collect()) == want
    assert sum(n for (_, x), n in want.items() if x) > 50


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def test_empty_tables(spark):
    e, labels = _empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.round_trip(e, queries.tokenizer("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(e, queries.tokenizer("word_bpe_49k.json"), 9).count() == 0
    assert lines.quality_rules(e).count() == 0
    assert toxicity.score_texts(e, toxicity.train(e, labels)).count() == 0
    assert quality.score_texts(e, quality.train(e, labels)).count() == 0
    assert language.identify(e, language.train(e, queries.tokenizer("byte_bpe_multi_50k.tiktoken"))).count() == 0


def _scores(rows, truth, held):
    got = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and held(r["doc_id"])]
    return sum(p == y for p, y in got) / len(got)


def test_classifiers_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = table(spark, sf, "labels").collect()
    for query, name, least in ((queries.op4_toxicity, "toxic", 0.96), (queries.op10_quality, "quality", 0.97)):
        rows = query(spark, sf).collect()
        assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
        assert _scores(rows, {x["doc_id"]: x[name] for x in labels}, held) > least


def test_factorization_machine_learns_pairs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):  # toxic only if an insult and a group stand together
        a, b = rng.integers(0, 2), rng.integers(0, 2)
        rows.append(" ".join(rng.permutation([*rng.choice(["one", "two", "three", "four"], 3), *["insult"] * a, *["group"] * b])))
        y.append(float(a and b))
    m = toxicity.fit(pa.array(rows), np.array(y), np.ones(len(y)))
    assert ((m.score(pa.array(rows)) >= 0.5) == (np.array(y) == 1)).all()
    assert 0 <= m.score(pa.array([None, "", "insult"])).max() < 0.5


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_language(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    model = language.train(table(spark, sf, "documents"), queries.tokenizer("byte_bpe_multi_50k.tiktoken"), chars_per_lang=20_000)
    odd = spark.createDataFrame([(1, None), (2, "123 ..."), (3, ""), (4, "x" * 100_000)], "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.langs


def test_forward_sums_all_segmentations():
    import numpy as np
    import pyarrow as pa

    pieces = pa.array([b"a", b"ab", b"b", b"abc", b"c", b"bc"], pa.binary())
    found = language.Pieces(pieces)
    names = [pieces[int(k)].as_py() for k in found.order]
    prob = np.arange(1.0, 7.0)[:, None] / 30
    p = dict(zip(names, prob[:, 0], strict=True))

    def brute(w):
        return 1.0 if not w else sum(p[w[:k]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    words = [b"abcab", b"cab", b"a", b"bbbabc", b"abc" * 5]
    model = language.Model(pieces, ["x"], prob)
    got = model.word_scores(pa.array(words, pa.binary()), found)[:, 0]
    assert np.allclose(got, np.log([brute(w) for w in words]))


def test_long_words_keep_their_sum(monkeypatch):
    """Cut where no piece stands across, byte by byte elsewhere, in stretches or at once: the same sums."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    pieces = pa.array(sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"bca", b"xx", b"xxxxx", "日本".encode(), "本".encode(), b"long piece"}), pa.binary())
    table = language.Pieces(pieces)
    prob = np.random.default_rng(1).random((len(pieces), 3))
    prob /= prob.sum(0)
    model = language.Model(pieces, ["x", "y", "z"], prob)
    names = ["".join(rng.choice(["a", "b", "c", "x", "xx", "日本", "é", "long piece"]) for _ in range(n)).encode() for n in (3, 20, 60, 300)] + [b"x" * 700, b""]

    def brute(w):
        a = np.zeros((len(w) + 1, 3))
        scale = np.zeros(3)
        by_name = {pieces[int(k)].as_py(): prob[i] for i, k in enumerate(table.order)}
        a[0] = 1
        for end in range(1, len(w) + 1):
            for k in range(1, min(10, end) + 1):
                if w[end - k : end] in by_name:
                    a[end] += a[end - k] * by_name[w[end - k : end]]
            if end % 20 == 0:
                most = a[end].copy()
                a /= most
                scale += np.log(most)
        return np.log(a[len(w)]) + scale

    want = np.array([brute(w) for w in names])
    assert np.allclose(model.word_scores(pa.array(names, pa.binary()), table), want, rtol=1e-9)
    monkeypatch.setattr(language, "STRETCH", 37)
    assert np.allclose(model.word_scores(pa.array(names, pa.binary()), table), want, rtol=1e-9)
    monkeypatch.setattr(language, "TOGETHER", 4)
    assert np.allclose(model.word_scores(pa.array(names, pa.binary()), table), want, rtol=1e-9)


def test_language_sample_is_bounded_and_the_same(spark):
    rows = [(lang, f"{lang} text {k} " * (k % 7 + 1)) for lang in "ab" for k in range(900)] + [("a", "same text")] * 500 + [("b", "long " * 9000), (None, "x"), ("c", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    langs, first = language.learning_sample(docs, 8000)
    _, second = language.learning_sample(docs.repartition(2), 8000)
    assert langs == ["a", "b"] and first.equals(second)
    chars = collections.Counter()
    for lang, text in zip(first["lang"].to_pylist(), first["text"].to_pylist()):
        chars[lang] += len(text)
    assert all(1000 < chars[x] < 24_000 for x in langs)
    assert language.identify(docs.limit(0).selectExpr("1L AS doc_id", "text"), language.train(docs.limit(0), queries.tokenizer("byte_bpe_multi_50k.tiktoken"))).count() == 0


def test_language_of_odd_rows(spark):
    """NULL ids, repeated rows, ties, very long texts and columns with the operator's own names."""
    rows = [(k, ("the cat sat on the mat " if k % 2 else "die katze sass auf der matte ") * 9, "en" if k % 2 else "de") for k in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), queries.tokenizer("byte_bpe_multi_50k.tiktoken"))
    odd = [(1, "the mat", "x", 9), (1, "the mat", "x", 9), (None, "die matte", "y", 9), (2, None, "z", 9), (3, "the " * 100_000, "z", 9), (4, "é" * 50_000, "z", 9), (5, "...", "z", 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string, score int")
    got = sorted(((r["id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in language.identify(docs, model).collect()), key=repr)
    assert [g for g in got if g[0] != 4] == sorted([(1, "en", True), (1, "en", True), (None, "de", True), (2, "und", True), (3, "en", True), (5, "und", True)], key=repr)
    assert language.identify(docs, language.train(docs.selectExpr("text", "CAST(NULL AS STRING) AS lang"), queries.tokenizer("byte_bpe_multi_50k.tiktoken"))).filter("lang_pred <> 'und'").count() == 0


def test_line_rules_and_copies_with_clashing_columns(spark):
    from sparrel.llm import jaccard

    rows = [(1, "one two three four five six " * 5, "a", 3, "k", 1.5), (None, "x y", "b", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host int, node string, component double")
    assert lines.apply_rules(docs).columns == docs.columns and jaccard.drop_copies(docs).count() == 2
    assert lines.apply_rules(docs.limit(0)).count() == 0 and jaccard.similar_groups(docs.limit(0)).count() == 0
