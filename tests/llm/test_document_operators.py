"""Joins, decontamination, archives, extraction and the pipeline against brute force."""

import base64
import collections
import hashlib
import random
import re

import pytest

from sparrel.llm import components, decontaminate, html_text, jaccard, queries, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute_groups(rows):
    """(id, size, component) of each row: all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), None if i is None else i if not s else min(least[find(k)])) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_equals_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(40)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (None, "a b c d e f g"), (1003, "a b c d e f g"), (1003, "a b c d e f g"), (1004, "x " * 3000)]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 7, 9, 12, 20, 60]))]
        for c in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            w += [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 1, 2]))]
            text = rng.choice([" ", "\t", "\n  "]).join(w)
            rows.append((k * 10 + c, text.upper() if rng.random() < 0.3 else text))
    group = [f"g{k}" for k in range(80)]  # a large group of near copies
    for c in range(40):
        w = list(group)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"edit{rng.randrange(99)}"
        rows.append((5000 - c, " ".join(w)))
    if seed:  # components in blocks, and every boundary between light and heavy
        monkeypatch.setattr(jaccard, "BLOCK", 4)
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, length: (0, 9)[seed - 1])
        monkeypatch.setattr(jaccard, "LONG", (3, 10)[seed - 1])
        monkeypatch.setattr(jaccard, "PASSING", (2, 7)[seed - 1])
        monkeypatch.setattr(jaccard, "SAMPLED", (1, 2)[seed - 1])
        monkeypatch.setattr(jaccard, "MOST_FREQUENT", (10**6, 0)[seed - 1])
        monkeypatch.setattr(components, "HUB", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard.similar_groups(docs).collect()), key=repr)
    assert got == brute_groups(rows)


def test_jaccard_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f", 1), (2, "A b c d e f", 2), (3, "q r s t u v w", 3), (4, None, 4), (5, "", 5), (2, "A b c d e f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    assert sorted(r["doc_id"] for r in jaccard.drop_copies(docs).collect()) == [1, 3, 4, 5]
    assert jaccard.drop_copies(docs.limit(0)).count() == 0


def test_entries_by_join_equal_those_by_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 40, 200])))) for k in range(80)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(1)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    monkeypatch.setattr(jaccard, "LEAST_SAMPLED", 2)
    frequent, length = jaccard.frequent_shingles(jaccard.find_nodes(docs))
    assert frequent.count() > 20 and length > 1
    first = sorted(tuple(r) for r in jaccard.list_entries(docs, 2, frequent).collect())
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 0)
    assert first == sorted(tuple(r) for r in jaccard.list_entries(docs, 2, frequent).collect())


def test_needed_and_prefix():
    import numpy as np

    for a in range(1, 40):
        for b in range(a, 60):
            c = jaccard.needed(a, b)
            assert 100 * c >= 75 * (a + b - c) and 100 * (c - 1) < 75 * (a + b - c + 1)
            if c <= a:
                assert a - c + 1 <= jaccard.prefix_size(np.array([a]))[0] and b - c + 1 <= jaccard.prefix_size(np.array([b]))[0]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_very_many_edges(spark, monkeypatch):
    """What tells rounds apart does not overflow. A star is as it was after a round, so it stands for all rounds."""
    star = spark.range(1 << 25).selectExpr("id + 1 AS u", "0L AS v")
    monkeypatch.setattr(components, "cut", lambda df, tag: star)
    monkeypatch.setattr(components, "_star", lambda edges: edges)
    assert components.components(star).columns == ["node", "component"]


def distance_to_substring(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_equals_dynamic_programming(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 30)))) for k in range(12)] + [(90, None), (91, ""), (92, "!!")]
    docs = [(1000, None), (1001, ""), (1002, "é" * 5000)]
    for k in range(80):
        text = " ".join(word() for _ in range(30))
        if k % 2:
            copy = list(items[rng.randrange(12)][1])
            for _ in range(rng.randint(0, int(len(copy) * 0.12))):
                at = rng.randrange(len(copy))
                copy[at] = rng.choice(["", "x", copy[at] + "y"])
            text = text + " — " + "".join(copy).replace(" ", rng.choice([" ", "\n", ", "])).upper() + "; " + text
        docs.append((k, text))
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(d, b).collect()
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    want = {(i, k): n for i, t in docs for k, item in items if plain(item) and (n := distance_to_substring(plain(item), plain(t))) <= int(len(plain(item)) * decontaminate.ERROR_RATE)}
    least = {}
    for r in found:
        least[r["id"], r["item"]] = min(r["distance"], least.get((r["id"], r["item"]), 10**9))
    assert least == want
    by_id = dict(docs)
    assert all(plain(by_id[r["id"]][r["start"] : r["end"]]) == plain(dict(items)[r["item"]]) for r in found if r["distance"] == 0)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_decontamination_of_odd_items(spark, monkeypatch):
    """Short items as whole words, repeated items and rows, empty tables, items in several blocks."""
    items = [(1, "cat"), (2, "cat"), (3, "a whole sentence that stands in some documents"), (None, "dog house"), (5, None), (6, "?!")]
    docs = [(1, "concatenate"), (2, "The cat!"), (2, "The cat!"), (None, "dog-house"), (4, None), (5, "see: A whole sentence that stands in some document, s"), (6, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(2, 1), (2, 2)] * 2 + [(None, None), (5, 3)], key=repr)
    for chars in (8_000_000, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        found = decontaminate.find_leaks(d, b)
        assert sorted(((r["id"], r["item"]) for r in found.collect()), key=repr) == want
        assert sorted((r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()), key=repr) == [1, 4, 6]
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0
    assert decontaminate.drop_leaks(d, b.limit(0)).count() == len(docs) and decontaminate.drop_leaks(d.limit(0), b).count() == 0


def test_archives_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    pages = [(k, f"https://h{k % 5}.example.com/p{k // 10}?x={k % 3}", f"<p>{k % 13} é</p>") for k in range(200)]
    pages += [(300, None, None), (301, "no url\r\n", ""), (302, "https://h1.example.com/", None), (None, "https://h1.example.com/z", "<p>3 é</p>"), (7, pages[7][1], pages[7][2])]
    rows = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, key string").repartition(3)
    files = warc.archive_pages(rows)
    got = warc.read_records(warc.find_captures(rows, files)).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = collections.Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        same = i == first[h or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else first[h or ""]] += 1
    assert collections.Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["kind"], r["refers_to"]) for r in got) == want
    assert all(r["intact"] for r in got)
    index = warc.CaptureIndex(files)
    for url in {p[1] for p in pages if p[1]}:
        assert sorted((c[1] for c in index.captures(url)), key=repr) == sorted((i for i, u, _ in pages if u and warc.url_key(u) == warc.url_key(url)), key=repr)
    assert list(index.captures("https://nowhere.example.com/")) == []
    assert {f["warc-type"] for f, _ in index.records(pages[0][1])} <= {"response", "revisit"}
    some = spark.createDataFrame([(pages[0][1],), (pages[0][1] + "#top",), ("https://nowhere.example.com/",), (None,), ("zzz",)], "url string")
    keys = {warc.url_key(pages[0][1]), "-"}
    assert collections.Counter(r["id"] for r in warc.read_records(warc.find_captures(some, files)).collect()) == collections.Counter(i for i, u, _ in pages if warc.url_key(u) in keys)
    assert warc.read_records(warc.find_captures(some.limit(0), files)).count() == 0
    assert warc.read_records(warc.find_captures(rows, warc.archive_pages(rows.limit(0)))).count() == 0


def test_index_reads_few_blocks(spark, monkeypatch):
    """A search reads the blocks that can hold its key; searches in order read a block once."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    pages = [(k, f"https://h.example.com/{k:04d}", f"<p>{k}</p>") for k in range(500)] + [(1000 + k, "https://many.example.com/", f"<i>{k}</i>") for k in range(45)]
    captures = warc.write_archives(warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string")), warc.shared_dir(spark, "warc"))
    upper = warc.upper_level(warc.write_index(captures, warc.shared_dir(spark, "idx"), files=1, block_lines=10))
    read = []
    plain = warc.block
    monkeypatch.setattr(warc, "block", lambda file, at, length: read.append(at) or plain(file, at, length))
    with open(upper[0][2].removeprefix("file://").removeprefix("file:"), "rb") as file:
        index = warc.IndexFile(file)
        assert len(index.blocks) == 55
        for k in range(0, 500, 7):
            assert [c[1] for c in index.captures(warc.url_key(pages[k][1]))] == [k]
        assert len(read) <= 55 + 8 and len(set(read)) <= 51  # first keys of blocks are looked for in the block before, too
        read.clear()
        assert sorted(c[1] for c in index.captures("com,example,many)/")) == list(range(1000, 1045)) and len(read) <= 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a><li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title {k}</h1><p>First &amp; <b>bold</b>&nbsp; text {k}<p>Second<br>line<aside>See also</aside><form><label>Mail</label></form><table><tr><td>x<td>y</table>
<ul><li>one<li>two</ul><section class="comments"><p>Nice!</p></section></article><div id="sidebar"><p>Links</p></div><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    rows = [(k, f"https://a.example.com/{k}", PAGE.format(k=k)) for k in range(3)]
    rows += [(10, None, None), (11, "::bad", ""), (12, "https://b.example.com", "just text &lt;b&gt;"), (13, "https://b.example.com", "<p>a <!-- b <p>x</p> --> c"), (14, "x", "<script>never closed <p>no")]
    rows += [(20 + k, f"https://site.example.com/{k}", f"<div><div class=x1><p>All about us</p></div><div class=x2><p>Story number {k} is told here.</p><p>It ends {k}.</p></div><div class=x3>Read the terms</div></div>") for k in range(8)]
    got = {r["id"]: r for r in html_text.extract(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert got[1]["text"] == "Title 1\nFirst & bold text 1\nSecond line\nx\ny\none\ntwo"
    assert got[10]["text"] == got[11]["text"] == got[14]["text"] == "" and got[12]["text"] == "just text <b>" and got[13]["text"] == "a c"
    assert all(got[20 + k]["text"] == f"Story number {k} is told here.\nIt ends {k}." for k in range(8))  # by importance alone
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_importance_decides_outside_of_declared_parts(spark):
    story = "<div class=story><p>Story number {k} is told here.</p><p>It ends {k}.</p></div>"
    frame = "".join(f"<div class=f{c}>Fixed part {c}</div>" for c in "abcdefghijkl")
    teaser = "<article class=card><p>Read our best offers</p></article>"
    rows = [(k, f"https://teaser.example.com/{k}", f"<body>{frame}{story.format(k=k)}{teaser}</body>") for k in range(12)]
    rows += [(20 + k, f"https://framed.example.com/{k}", f"<body><div class=w>{frame}<article>{story.format(k=k)}</article></div></body>") for k in range(12)]
    rows += [(40, "https://one.example.com/", f"<body>{story.format(k=40)}{teaser}</body>")]
    rows += [(50 + k, f"https://inside.example.com/{k}", f"<body><div class=w>{frame}<main><p>Same in all</p></main></div><p>Own {k}</p></body>") for k in range(5)]
    got = {r["id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    told = lambda k: f"Story number {k} is told here.\nIt ends {k}."
    assert all(got[k] == told(k) and got[20 + k] == told(k) for k in range(12))
    assert got[40] == told(40) + "\nRead our best offers"
    assert all(got[50 + k] == f"Same in all\nOwn {k}" for k in range(5))  # a main part is judged by itself


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as pipeline
    from sparrel.llm import lines, toxicity
    from sparrel.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    machine = toxicity.train(docs, table(spark, sf, "labels"))
    kept = {r["doc_id"]: r["text"] for r in lines.apply_rules(docs, texts=True).collect()}
    verdict = {r["id"]: r["kept"] for r in lines.quality_rules(docs, texts=True).collect()}
    assert set(kept) == {i for i, k in verdict.items() if k}
    import pyarrow as pa

    kept = {i: t for i, t in kept.items() if machine.score(pa.array([t]))[0] < 0.5}
    groups = brute_groups(sorted(kept.items()))
    kept = {i: kept[i] for i, _, c in groups if i == c}
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    items = [plain(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(item in plain(t) for item in items)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in kept.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in pipeline.run(spark, sf).collect()} == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """NULLs in any column, repeated rows, columns with names that operators use, and empty tables go through all stages."""
    import corpus_pipeline as pipeline

    words = ["w" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(400)]
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(words) for _ in range(40))
    some = [(k, text(), None if k % 3 else "en", None if k % 4 else "src", 7, "x") for k in range(40)]
    rows = [*some, some[0], (None, text(), "en", "src", None, None), (100, None, None, None, None, None), (101, "", "en", "src", 0, "y"), (102, some[1][1], "en", "src", 1, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component string"
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(40)]
    for name, kept in (("full", rows), ("empty", [])):
        sf = tmp_path / name
        spark.createDataFrame(kept, schema).write.parquet(str(sf / "documents.parquet"))
        spark.createDataFrame(labels if kept else [], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        spark.createDataFrame([(1, some[2][1]), (2, None)] if kept else [], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
        docs = spark.read.parquet(str(sf / "documents.parquet"))
        for _, stage in pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(sf))
            assert got.schema.names == docs.schema.names and got.count() <= docs.count()
        out = pipeline.run(spark, str(sf)).collect()
        assert (len(out) > 0) == bool(kept) and not {2, 100, 101} & {r["doc_id"] for r in out}
