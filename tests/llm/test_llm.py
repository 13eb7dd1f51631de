"""The ten operators against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quorumspark.llm import bpe, chat, decontaminate, html, lines, minhash, quality, suffix, urls, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string, source string, n_chars long, u1 string, bucket int, id string"
LONG = " ".join(f"word{i}" for i in range(400))


def docs(spark, rows):
    """Rows with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, s, len(t or ""), "x", 1, "y") for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def some(spark):
    near = LONG.replace("word200", "other")
    return docs(spark, [(1, LONG, "a"), (2, LONG, "a"), (3, near, "b"), (4, None, "a"), (5, "", None), (6, "few words", "a"), (7, "x" * 3000, "a"), (7, "x" * 3000, "a"), (None, "a b c d e f " * 40, "b"), (9, " ".join(f"own{i}" for i in range(300)), "b"), (10, "Éa 中\U0001f600\n\n  z\t ", "c")])


def test_near_duplicates(spark, some):
    got = {}
    for r in minhash.near_duplicates(some).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].class_id for i in (1, 2, 3)] == [1, 1, 1] and got[3][0].rep_id == 3 and got[3][0].n_links == 1
    assert got[9][0].class_id == 9 and len(got[7]) == 2 and got[7][0].class_id == 7 and got[None][0].class_id is None
    assert got[4][0].class_id == got[5][0].class_id == 4
    kept = minhash.keep_one(some)
    assert kept.columns == some.columns and {1, 9, 6} <= {r.doc_id for r in kept.collect()} and not {2, 3, 5} & {r.doc_id for r in kept.collect()}
    assert minhash.near_duplicates(some.limit(0)).count() == 0


def weighted_jaccard(texts, k=5):
    """Weights of each text's shingles (the nth of its kind is one of its own), and the similarity of two texts, by definition."""
    words = [(t or "").lower().split() for t in texts]
    sets = [Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter() for w in words]
    df = Counter(s for c in sets for s in c)
    idf = {s: 1 + np.log((1 + len(texts)) / (1 + n)) / np.log(1 + len(texts)) for s, n in df.items()}
    total = [sum(n * idf[s] for s, n in c.items()) for c in sets]

    def similar(i, j):
        both = sum(min(n, sets[j][s]) * idf[s] for s, n in sets[i].items() if s in sets[j])
        return both / max(total[i] + total[j] - both, 1e-300)

    return words, similar


@pytest.mark.parametrize("pairs_per_bucket", [12_000_000, 3000, 320])
def test_links_equal_all_pairs(spark, pairs_per_bucket):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 5000)}"
    line = " ".join(f"shared{i}" for i in range(30))  # in half of the texts: its shingles are hot in small buckets
    bases = [[word() for _ in range(int(rng.integers(20, 90)))] for _ in range(12)]
    texts = []
    for i in range(150):
        t = list(bases[i % 12]) if i % 3 else [word() for _ in range(40)]
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(0, len(t)))] = word()
        texts.append(" ".join(t) + (f" {line} {line}" if i % 2 else ""))
    texts += texts[:20] + [None, "", "few words", "w " * 300]
    words, similar = weighted_jaccard(texts)
    n = len(texts)
    links, root = [set() for _ in range(n)], list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in combinations(range(n), 2):
        if words[i] == words[j] or similar(i, j) >= 0.8:
            root[find(j)] = find(i)
            if words[i] != words[j]:
                links[i].add(tuple(words[j]))
                links[j].add(tuple(words[i]))
    low = {}
    for i in range(n):
        low.setdefault(find(i), i)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(6), pairs_per_bucket=pairs_per_bucket, block=16).collect()}
    assert [got[i].class_id for i in range(n)] == [low[find(i)] for i in range(n)]
    assert [got[i].n_links for i in range(n)] == [len(x) for x in links] and sum(map(len, links)) > 200


def test_recall_of_given_documents_against_all_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    words, similar = weighted_jaccard([r.text for r in rows])
    cls = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    pairs = [(i, j) for i in range(0, len(rows), 20) for j in range(len(rows)) if i != j and (words[i] == words[j] or similar(i, j) >= 0.8)]
    assert all(cls[rows[i].doc_id] == cls[rows[j].doc_id] for i, j in pairs)


def test_repeated_substrings(spark, some):
    got = suffix.digest(suffix.repeated_substrings(some)).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in some.collect()]
    count = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffix.repeated_substrings(some.limit(0)).count() == 0


def test_repeated_substrings_of_periodic_texts(spark):
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    p7, p90, p150, p260 = (letters(n) for n in (7, 90, 150, 260))
    texts = ["a" * 4000, letters(90) + "a" * 199 + letters(90), "b" * 200, p7 * 100, letters(60) + p7 * 40 + letters(60), p90 * 5, p150 * 4, p260 * 3, "x" * 230 + letters(250) + "x" * 230, "c" * 200 + letters(9), letters(9) + "c" * 200, None]
    d = docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(0, texts[0], "a"), (None, texts[7], "b")])
    got = sorted(((str(r.doc_id), r.n_bytes, [(x.start, x.stop) for x in r.spans]) for r in suffix.repeated_substrings(d).collect()), key=str)
    rows = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    count = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want.append((str(i), len(b), [m.span() for m in re.finditer(b"\1+", bytes(gone))]))
    assert got == sorted(want, key=str)


def test_rows_that_repeat_often_bring_their_spans_once(spark):
    text = " ".join(f"w{i * i}" for i in range(150))
    d = docs(spark, [(1, text, "a")] * 60 + [(2, "x" + text[:400] + "y", "a"), (None, "z" * 10, "b")])
    got = suffix.digest(suffix.repeated_substrings(d)).collect()
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id == 1] == [(len(text), 1)] * 60 and [r.n_removed for r in got if r.doc_id == 2] == [400]
    x = np.zeros(50, suffix.SPAN)
    assert len(suffix._by_text(x, suffix.SPAN, "spans")["spans"][0].as_py()) == suffix.SPAN.itemsize


def test_long_periodic_texts_take_bounded_memory(spark):
    d = docs(spark, [(1, "a" * 5_000_000, "a"), (2, "ab" * 1_000_000, "a"), (3, "x" + "a" * 300, "a")])
    got = {r.doc_id: r for r in suffix.digest(suffix.repeated_substrings(d)).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(5_000_000, 1), (2_000_000, 1), (300, 1)]
    # what the tasks hold: rows of the first step for a slice of one character
    data = np.full(1 << 20, 97, np.uint8)
    x = suffix.anchors(data, np.array([0, len(data)]), 200)
    out, known = suffix._periodic(x, data, np.array([0, len(data)]), 200)
    assert len(x) - len(out) < 5 and len(known) >= len(out)


def test_bpe_is_exact(spark, some):
    got = bpe.decode(bpe.encode(some, PATH, public_tokenizers.PATTERN), PATH).collect()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    want = [(r.doc_id, enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in some.collect()]
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)


def test_bpe_is_the_same_with_any_table(spark, some):
    want = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(some, PATH, public_tokenizers.PATTERN).collect()), key=str)
    texts = some.union(some).select("text")
    assert 0 < bpe.common_units(texts, public_tokenizers.PATTERN, 500, 10).count() <= 500
    for common, cache in ((0, 5), (300, 5), (100_000, 100_000)):
        got = bpe.encode(some, PATH, public_tokenizers.PATTERN, common=common, cache=cache)
        assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=str) == want
    assert bpe.decode(bpe.encode(some.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_bpe_odd_words():
    m = bpe.Merges(bpe.load_ranks(PATH))
    enc = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=m.ranks, special_tokens={})
    words = ["a" * n for n in range(1, 90)] + ["abab" * n for n in range(1, 20)] + ["  \n\t" * n for n in range(1, 9)]
    ids, count = m.replay([w.encode() for w in words])
    at = 0
    for w, n in zip(words, count, strict=True):
        assert ids[at : at + n].tolist() == enc.encode_ordinary(w)
        at += n


def test_quality(spark, some):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = sorted(quality.judged(some).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    want = []
    for r in some.collect():
        t = r.text or ""
        w = word.findall(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        ls = [x for x in t.split("\n") if word.search(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(ls) - len(set(ls)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == sorted(want, key=lambda x: (str(x[0]), x[1]))
    assert all(not r.kept for r in got if r.base_failed)


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    line = "Subscribe to our letter today and never miss a story again"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\n{line}", "h") for i in range(40)] + [(100, "\n".join([line] * 1 + [own(100).replace(" ", "-")] * 1 + [line] * 3), "h")] + [(200, f"{own(200)}\n{line}", "other")]
    kept = {r.doc_id: r.text for r in quality.clean(docs(spark, rows)).collect()}
    assert kept[3] == own(3) and 100 not in kept and kept[200].endswith(line)


def test_documents_of_mostly_boilerplate_are_counted_each(spark):
    word = lambda *key: hashlib.md5(repr(key).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:9]
    some = lambda n, *key: " ".join(word(k, *key) for k in range(n))
    rows = []
    for host, n, shared in (("a", 60, 90), ("b", 200, 270)):
        foot = "\n".join(some(30, "foot", host, k) for k in range(shared // 30))
        rows += [(len(rows) + i, f"{some(37, host, i)}\n{foot}", host) for i in range(n)]
    # copies of one text with a word changed in each, in different lines, are one document; so are those with two changed
    for i in range(120):
        copy = [some(20, "copy", k).split() for k in range(10)]
        copy[i % 10][i // 10] = word("new", i)
        copy[i * 7 % 10][19 - i % 7] = word("more", i)
        rows.append((1000 + i, "\n".join(map(" ".join, copy)), "c"))
    got = {r.doc_id: r for r in quality.judged(docs(spark, rows)).collect()}
    assert {(got[i].n_words_left, got[i].kept) for i in range(260)} == {(37, False)}
    assert {(got[1000 + i].n_words_left, got[1000 + i].kept) for i in range(120)} == {(200, True)}


def test_each_line_is_counted_by_distinct_documents(spark):
    """Quotations that 2 to 20 documents share, footers, exact and edited copies: every line's count, by who made the documents."""
    r = random.Random(6)
    word = lambda *key: hashlib.md5(repr(key).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:8]
    some = lambda n, *key: " ".join(word(k, *key) for k in range(n))
    rows, made = [], []
    for host in ("a", "b", None):
        quotes = [q for k in range(2, 21) for q in [some(60, "quote", host, k)] * k]
        n = len(quotes)
        r.shuffle(quotes)
        for i in range(n):
            lines = [some(12, "own", host, i), quotes[i], some(30, "foot", host)] + [some(9, "side", host, i % 4)] * (i % 4 > 0) + ["12 of 34"] * (i % 2)
            for copy in range(1 + 3 * (i == 5)):
                rows.append((len(rows), "\n".join(lines), host))
                made.append((host or "", i, lines))
    # one text in 90 edited copies counts as few documents, not as many
    for i in range(90):
        copy = [some(40, "copy", k).split() for k in range(8)]
        copy[i % 8][3 + i // 8] = word("new", i)
        rows.append((len(rows), "\n".join(map(" ".join, copy)), "c"))
    have = {}
    for host, i, lines in made:
        for line in set(lines):
            have.setdefault((host, line), set()).add(i)
    want = sorted((h, len(x)) for (h, _), x in have.items() if len(x) > 20)
    got = quality.line_counts(docs(spark, rows)).collect()
    assert sorted((g.host, g.n_docs) for g in got if g.host != "c") == want and {g.docs for g in got if g.host != "c"} == {209}
    assert all(g.n_docs < 15 for g in got if g.host == "c")
    # and so the footer goes from every document
    left = {x.doc_id: x.n_words_left for x in quality.judged(docs(spark, rows)).collect()}
    assert all(left[k] == sum(len(x.split()) for x in set(lines) if len(have[host, x]) <= 20) for k, (host, _, lines) in enumerate(made))


def test_line_chunks(spark):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(30))
    rows = [(1, f"first own\n{passage}\nend one", "a"), (2, f"intro\nsecond\n{passage}", "a"), (3, "alone\nhere", "b"), (4, None, "b"), (5, "\n\n\n", "b")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in lines.repeated_chunks(d).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1] and got[2].n_removed >= 20 and got[2].text.startswith("intro\nsecond")
    assert got[3].n_removed == 0 and got[4].n_lines == 1 and got[5].text == "\n\n\n"
    out = lines.dedup_lines(d)
    assert out.columns == d.columns and out.count() == 5 and lines.repeated_chunks(d.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none_keep_their_own_texts(spark):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(30))
    own = lambda x: "\n".join(f"own {x} line {i} of it" for i in range(9))
    rows = [(1, passage, "a"), (None, f"{passage}\n{own('a')}", "a"), (None, f"{passage}\n{own('g')}", "a"), (None, own("b"), "a"), (7, f"{passage}\n{own('c')}", "a"), (7, own("d"), "a"), (8, own("e"), "a"), (8, own("e"), "a")]
    got = [(r.doc_id, r.text) for r in lines.dedup_lines(docs(spark, rows)).collect()]
    assert len(got) == 8 and got.count((None, own("b"))) == 1 and got.count((7, own("d"))) == 1 and got.count((8, own("e"))) == 2
    assert sum(i is None and (t.endswith(own("a")) or t.endswith(own("g"))) and len(t) < len(passage) for i, t in got) == 1
    assert sum(i == 7 and t.endswith(own("c")) and len(t) < len(passage) for i, t in got) == 1


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    own = lambda x: " ".join(f"{x}word{i}" for i in range(200))
    near = own("a").replace("aword100", "other")
    rows = [(1, own("a"), "a"), (1, own("b"), "a"), (2, own("b"), "a"), (3, near, "a"), (3, own("c"), "a"), (4, own("d"), "a"), (4, own("d"), "b"), (None, own("a"), "a"), (None, own("e"), "a"), (None, own("e").replace("eword9 ", "more "), "a"), (None, own("f"), "a")]
    d = docs(spark, rows)
    got = [(r.doc_id, r.text) for r in minhash.keep_one(d).collect()]
    assert len(got) == 6 and {(1, own("a")), (1, own("b")), (3, own("c")), (4, own("d")), (None, own("f"))} <= set(got)
    assert sum(i is None and "eword50" in t for i, t in got) == 1 and minhash.keep_one(d.limit(0)).count() == 0


def test_rows_whose_names_collide_are_kept_apart(spark, monkeypatch):
    whole = minhash._names
    rows = docs(spark, [(i, " ".join(f"t{i}w{k}" for k in range(30)), "s") for i in range(20)] + [(30, LONG, "s"), (31, LONG, "s"), (31, LONG, "s")]).withColumn("_kept", F.lit(1))
    monkeypatch.setattr(minhash, "_names", lambda text, own: (F.pmod(whole(text, own)[0], F.lit(3)), whole(text, own)[1]))
    assert sorted(r.doc_id for r in minhash.keep_one(rows).collect()) == [*range(20), 30]


def test_decontamination(spark):
    item = " ".join(f"Bench{i}," for i in range(30))
    changed = item.replace("Bench10,", "zzz").replace("Bench20,", "yyy")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x y z"), (3, "too short")], "item_id long, text string")
    d = docs(spark, [(1, f"before {item} after", "a"), (2, f"{LONG} {changed} {LONG}", "a"), (3, LONG, "a"), (4, None, "a"), (5, " ".join(f"bench{i}" for i in range(9)), "a")])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(d, bench).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[2, 1].n_words == 30 and got[2, 1].n_equal == 28 and got[1, 1].first_word == 1
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == {3, 4, 5}
    assert decontaminate.overlaps(d, bench.limit(0)).count() == 0 and decontaminate.decontaminate(d, bench).columns == d.columns


def test_every_allowed_overlap_has_a_seed(spark):
    for n in (*range(5, 22), 25):
        item = " ".join(f"item{n}x{i}" for i in range(n))
        for m in range(min(13, n), n + 1):
            e = int(0.2 * m + 1e-9)
            if m > 16 and (m < n or e > 4):
                continue
            block = decontaminate.Items([(1, item, True)], 13, 0.8)
            h = block.words[0]
            for gone in combinations(range(1, m - 1), e):
                doc = np.concatenate((np.arange(9, dtype=np.uint64), h[:m], np.arange(9, dtype=np.uint64)))
                doc[[9 + g for g in gone]] = 5
                assert [0, 9, 0] in block.hits(doc, np.zeros(len(doc), np.int64), np.array([0, len(doc)])).tolist(), (n, m, gone)
    bench = spark.createDataFrame([(None, " ".join(f"none{i}" for i in range(14))), (2, " ".join(f"two{i}" for i in range(12)))], "item_id long, text string")
    d = docs(spark, [(1, " ".join(f"none{i}" for i in range(14)), "a"), (2, " ".join("new" if i == 4 else f"two{i}" for i in range(12)), "a"), (3, LONG, "a")])
    assert {(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.overlaps(d, bench).collect()} == {(1, None, 14), (2, 2, 11)}
    assert [r.doc_id for r in decontaminate.decontaminate(d, bench).collect()] == [3]


def brute_overlaps(texts, items):
    """Every document, item and diagonal: the longest stretch that begins and ends equal and is equal in 0.8 of its words."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for i, t in texts.items():
        d = words(t or "")
        for j, it in items.items():
            b = words(it or "")
            if len(b) < 5:
                continue
            for start in range(1 - len(b), len(d)):
                eq = [d[start + k] == b[k] if 0 <= start + k < len(d) else None for k in range(len(b))]
                at = [k for k, e in enumerate(eq) if e]
                best = max(((y - x + 1, -x, sum(map(bool, eq[x : y + 1]))) for x in at for y in at if y >= x and sum(map(bool, eq[x : y + 1])) >= 0.8 * (y - x + 1) - 1e-9), default=(0, 0, 0))
                if best[0] >= min(13, len(b)):
                    out.add((i, j, start - best[1], best[0], best[2]))
    return out


def test_overlaps_equal_brute_force_whatever_the_batches(spark):
    rng = np.random.default_rng(5)
    items = {k: " ".join(f"w{x}" for x in rng.integers(0, 40, n)) for k, n in enumerate((5, 6, 9, 12, 13, 14, 15, 20, 26, 60))} | {20: "same " * 14, 21: "a b c d"}
    texts = {}
    for i in range(60):
        t = [f"w{x}" for x in rng.integers(0, 40, 30)]
        b = items[i % 10].split()
        for k in rng.integers(0, len(b), len(b) // 5):
            b[k] = "zz"
        texts[i] = " ".join(t[:10] + b[: int(rng.integers(5, 99))] + t[10:])
        # an item's halves at the end of one text and the beginning of the next
        if i % 3 == 0:
            texts[i] += " " + " ".join(items[8].split()[:11])
        elif i % 3 == 1:
            texts[i] = " ".join(items[8].split()[11:]) + " " + texts[i]
    texts |= {90: "same " * 40, 91: None, 92: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = docs(spark, [(i, t, "a") for i, t in texts.items()])
    want = brute_overlaps(texts, items)
    assert len({(i, j) for i, j, *_ in want}) > 40
    for parts, block_words in ((1, 1_000_000), (7, 100)):
        got = [tuple(r) for r in decontaminate.overlaps(d.repartition(parts), bench, block_words=block_words).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {r.doc_id for r in decontaminate.decontaminate(d, bench).collect()} == set(texts) - {i for i, *_ in want}


def test_long_items_are_searched_in_pieces(spark):
    words = [f"w{i}" for i in range(25_000)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    d = docs(spark, [(k, " ".join(["x"] + words[a : a + 20] + ["y"]), "a") for k, a in enumerate((0, 9_930, 9_945, 9_960, 9_990, 19_880, 24_980))] + [(50, " ".join(words[9_000:11_000]), "a"), (51, "same " * 60_000, "a")])
    got = Counter(r.doc_id for r in decontaminate.overlaps(d, bench).collect())
    assert all(got[k] >= 1 for k in range(7)) and got[50] >= 1 and 51 not in got


def test_longest_stretch():
    rng = np.random.default_rng(1)
    for _ in range(300):
        e = (rng.random(int(rng.integers(1, 30))) < 0.7).astype(float)
        i, j = decontaminate.longest(e, 0.8)
        every = [(b - a, -a) for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a] and e[b - 1] and e[a:b].mean() >= 0.8 - 1e-9]
        assert (j - i, -i) == max(every, default=(0, 0))


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "a\\<\\[INST]\\\\", "<|user|>\n<|>", None, "", "<\\/s> |\\> [\\INST]"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(bad)] + [(2, 0, "assistant", "x"), (None, 0, None, "y"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(turns).select("*", chat.turns_of(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r[2], r[3] or "") for r in rows[:6]]
    assert got[1].loss == "".join(t or "" for t in bad[1::2]) and got[1].valid and not got[2].valid and not got[3].valid and len(got[3].back) == 2
    assert got[1].formatted.count("</s>") == 6 and chat.format_chats(turns.limit(0)).count() == 0


CLASH = ["host", "path", "rule", "node", "u1", "u2", "id", "gone", "rest", "stream", "is_open", "k", "n", "at", "item", "starts", "chunks", "lines"]


def test_extra_columns_whose_names_clash_change_nothing(spark, some):
    more = lambda df: df.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in df.columns))
    same = lambda f, df: sorted(map(str, f(df).collect())) == sorted(map(str, f(more(df)).collect()))
    pages = spark.createDataFrame([(1, "https://a.net/x", "<p>one</p>"), (2, None, None), (2, "https://b.org/y", '<link rel="canonical" href="https://a.net/x"><p>two')], "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, None, "")], "conv_id long, turn long, role string, text string")
    bench = spark.createDataFrame([(1, LONG[:200])], "item_id long, text string")
    plain = some.select("doc_id", "text", "source")
    assert same(urls.filter_urls, pages) and same(html.main_text, pages) and same(lambda d: chat.digest(chat.format_chats(d)), turns)
    assert same(lambda d: warc.digest(warc.read_archives(warc.write_archives(d))), pages)
    assert same(lambda d: quality.judged(d).drop("boilerplate", "u1", "u2"), plain) and same(lines.repeated_chunks, plain) and same(lambda d: decontaminate.overlaps(d, bench), plain)
    assert same(lambda d: suffix.digest(suffix.repeated_substrings(d)), plain)
    for keep in (quality.clean, lines.dedup_lines, minhash.keep_one, lambda d: decontaminate.decontaminate(d, bench)):
        out = keep(more(plain))
        assert out.columns == more(plain).columns and sorted(map(str, out.select("doc_id", "text", "source").collect())) == sorted(map(str, keep(plain).collect()))


def test_empty_tables_give_empty_results(spark, some):
    none = some.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert quality.judged(none).count() == quality.clean(none).count() == lines.dedup_lines(none).count() == bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
    assert urls.filter_urls(pages).count() == html.main_text(pages).count() == 0


def test_urls(spark):
    page = lambda link: f'<html><head><link href="{link}" rel="canonical"></head>'
    rows = [(1, "https://a.net/x", None), (2, "https://b.org/y", page("https://A.net/x")), (3, "https://example.net/en/1", page("https://c.org/z")), (4, "https://c.org/z", page("/w")), (5, "https://c.org/w", ""), (6, None, None), (7, "nothing", ""), (8, "http://d.org/q", '<meta http-equiv="Refresh" content="0; url=https://b.org/y">'), (9, "http://e.net", ""), (9, "http://e.net", "")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[3].rule == "example.net/en/" and got[8].propagated and got[9].rule is None and got[6].host == ""


def test_decisions_reach_all_aliases_of_generated_pages(spark):
    """Chains, cycles, a hub and conflicts of allow and block over 500 pages, against a plain closure."""
    r = random.Random(9)
    hosts = ["a.net", "b.org", "Example.NET", "c.example.net", "example.com", "d.io", "e.io"]
    paths = ["/", "/en/", "/de/", "/fr/", "/x/y", ""]
    node = lambda u: re.sub("^.*?://", "", u).split("#")[0] if not (m := re.match("^.*?://([^/?#]*)(.*)$", u)) else m[1].lower() + m[2].split("#")[0]
    url = [f"http{'s' * (i % 2)}://{r.choice(hosts)}{r.choice(paths)}{'?p=' if r.random() < 0.5 else '/n'}{i}{'#f' * (i % 7 == 0)}" for i in range(500)]
    rows, edges = [], []
    for i, u in enumerate(url):
        to = url[i - 1] if i < 60 and i % 20 else url[10 * (i // 10)] if i < 200 else url[250] if i < 330 else r.choice(url) if i < 420 else None
        html_ = f"<html><body>page {i}"
        if to:
            site, form = re.match("^(.*?)://([^/?#]*)", to), i % 4
            own = re.match("^(.*?)://([^/?#]*)", u)
            link = to.replace("&", "&amp;")
            if form == 1:
                link, to = f"//{site[2]}{to[site.end():]}", f"{own[1]}://{site[2]}{to[site.end():]}"
            elif form == 2:
                link, to = f"/moved{i}", f"{own[0]}/moved{i}"
            html_ = f'<html><head><link rel="canonical" href="{link}"></head>' if i % 3 else f"<meta content='0;url={link}' http-equiv=refresh>"
            edges.append((node(u), node(to), to))
        rows.append((i, u, html_))
    rows += [(500, None, None), (501, "no address", "<link rel=canonical href=http://a.net/>")]
    rule = lambda n: max(((len(x), a == "allow", x, a) for a, x in urls.RULES if ((h := n.split("/")[0].split("?")[0]) == (s := x.split("/")[0]) or h.endswith("." + s)) and n[len(h):].split("?")[0].startswith(x[len(s):])), default=None)
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, spread = {}, 0
    for i, u, _ in rows:
        n = node(u) if u and "://" in u else None
        own, verdict = rule(n) if n else None, "allow"
        if own:
            verdict = own[3]
        elif n in near:
            seen, todo = {n}, [n]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            actions = {x[3] for x in map(rule, seen) if x}
            verdict = "allow" if "allow" in actions or not actions else "block"
            spread += bool(actions)
        want[i] = (own[2] if own else None, verdict)
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: (x.rule, x.verdict) for x in got} == want
    assert sum(x.propagated for x in got) == spread > 60 and {"allow", "block"} == {x.verdict for x in got if x.propagated}


def test_warc(spark):
    big = "é" * 400_000
    rows = [(1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, None), (4, "u\r\n", "short"), (5, "v", "short"), (6, "w", big), (None, "n", "x" * 1000), (7, "s", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.read_archives(warc.write_archives(pages)).cache()
    got = {r.page_id: r for r in warc.digest(chunks).collect()}
    assert len(got) == 8 and (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert chunks.where("record_id LIKE 'urn:page:6:%'").count() == 4
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    clashing = pages.selectExpr("*", "1 AS k", "2 AS chunk", "'x' AS id", "3 AS d", "4 AS first")
    assert sorted(map(str, warc.digest(warc.read_archives(warc.write_archives(clashing))).collect())) == sorted(map(str, warc.digest(chunks).collect()))


def test_archives_of_a_task_that_runs_again_list_one_attempt(spark, tmp_path):
    pages = spark.range(20).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(cast(id AS string), 2000) AS html")
    files = [warc.write_archives(pages, f"{tmp_path}/w") for _ in range(2)]
    for f in files:
        assert f.agg(F.sum("n_records")).first()[0] == 20 and warc.digest(warc.read_archives(f)).select("page_id").distinct().count() == 20
    assert not set(files[0].toPandas().path) & set(files[1].toPandas().path)


def test_main_text(spark):
    foot = "This long footer text repeats on every page of the host word for word"
    a = '<nav>menu</nav><div class="ad">buy</div><article><header>by me</header><h1>T &amp; x</h1><p>one<br>two  <b>three</b><p>four<form>f</form><aside>s</aside><div id="comments"><p>c</p></div></article><footer>end'
    rows = [(1, "http://h/1", a), (2, "http://h/2", f"<body><p>own words of page two</p><p>{foot}</p>"), (3, "http://h/3", f"<body><p>other words</p><p>{foot}</p>"), (4, "http://h/4", None), (5, None, "plain &lt;text&gt;"), (6, "http://h/6", "<script>var a='<p>';</script><style>x</style><main>m<!-- c --></main>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "T & x\none two three\nfour" and got[2] == "own words of page two" and got[3] == "other words"
    assert got[4] == "" and got[5] == "plain <text>" and got[6] == "m"


@pytest.mark.parametrize(("page", "want"), [
    ('<article><h2 id="search">Search algorithms</h2><p>Binary search halves.</p></article>', "Search algorithms\nBinary search halves."),
    ('<article><div class="side-by-side"><p>Body text A</p></div></article>', "Body text A"),
    ('<article><section id="related"><p>Earlier work by <a href="x">Ng</a> found the same in all of its trials.</p></section></article>', "Earlier work by Ng found the same in all of its trials."),
    ('<article><p>b</p><section id="related"><ul><li><a href="1">One more story</a></li><li><a href="2">Another</a></li></ul></section></article>', "b"),
    ('<article>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</article>', "Let x=1 be."),
    ('<article><p id="comments">A paragraph.</p><h3 class="comment">Head</h3><p class="ad">buy</p></article>', "A paragraph.\nHead"),
    ('<article><p>t</p><div class="search-box"><input name="q"> find</div><div class="comment-list"><p>me too</p></div><div class="cookieNotice">ok?</div></article>', "t"),
    ('<article class="post comments-open"><p>kept</p><div class="ad-slot-2">ad</div><div class="site-footer">f</div><div id="discussion"><p>We discuss at length.</p></div></article>', "kept\nWe discuss at length."),
    ('<article><div class="admonition">A note.</div><div class="headerless shared">Also text.</div></article>', "A note.\nAlso text."),
])
def test_names_of_prose_do_not_cost_text(page, want):
    assert "\n".join(html.blocks_of(page)[0]) == want


def test_repeated_substrings_of_a_host_against_brute_force(spark):
    rng = np.random.default_rng(3)
    foot = [" ".join(f"foot{k}x{i}" for i in range(12)) for k in range(3)]
    own = lambda i, n: " ".join(f"o{i}x{rng.integers(0, 9999)}" for _ in range(n))
    pages = {}
    for i in range(24):
        parts = [own(i, 30), foot[i % 3], own(i, 20)]
        if i % 4 == 0:
            parts.insert(1, foot[(i + 1) % 3])
        pages[i] = (f"h{i % 2}", [" ".join(parts[:2]), *parts[2:]])
    pages[24] = ("h0", pages[0][1])  # a copy: does not make its own text boilerplate
    pages[25] = ("h0", [pages[2][1][0].replace("o2x", "p2x", 1), *pages[2][1][1:]])  # an edited copy: both stay whole
    pages[26] = ("h2", [foot[0], own(26, 9)])  # one page of its host
    rows = [(i, f"http://{h}/{i}", "<body><nav>menu of it</nav>" + "".join(f"<p>{b}</p>" for b in blocks) + f"<form>{foot[2]}</form>", "x") for i, (h, blocks) in pages.items()]
    streams = {i: (h, " ".join(blocks).split()) for i, (h, blocks) in pages.items()}
    seen = {}
    for i, (h, t) in streams.items():
        for part in (t, ["menu", "of", "it", *foot[2].split()]):
            for k in range(len(part) - 7):
                seen.setdefault((h, tuple(part[k : k + 8])), set()).add(tuple(t))
    want = {}
    for i, (h, t) in streams.items():
        cover = {p for k in range(len(t) - 7) if len(seen[h, tuple(t[k : k + 8])]) > 1 for p in range(k, k + 8)}
        if len(t) - len(cover) < 0.1 * len(t):
            cover = set()
        at, out = 0, []
        for block in pages[i][1]:
            left = [w for p, w in enumerate(block.split(), at) if p not in cover]
            at += len(block.split())
            out += [" ".join(left)] if left else []
        want[i] = "\n".join(out)
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)
    got = {r.page_id: r.text for r in html.main_text(table, keep=("page_id", "host")).collect()}
    assert got == want and "foot" not in got[5] and "foot0" in got[26] and got[25].split("\n")[0].startswith("p2x")
    assert html.main_text(table.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    out = P.run(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in out.collect()}
    all_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = quality.judged(all_docs).where("kept").count()
    assert 0 < len(ids) <= clean and len(P.STAGES) == 5 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    own = lambda i, n=120: " ".join(f"t{i}x{k}" for k in range(n))
    item = " ".join(f"Bench{i}" for i in range(40))
    texts = {1: own(1), 2: own(1), 3: own(1).replace("t1x60", "else"), 4: own(4), 5: "too few words", 6: None, 7: "", 8: "one two three four five six seven eight nine " * 30, 9: f"{own(9)} {item} {own(90)}", 10: own(10) + " Éa 中\U0001f600", 11: own(11).replace("t11x60", "x"), 12: own(11), 13: f"{own(13, 60)} {own(14, 60)}", 14: f"{own(13, 60)} {own(15, 60)}"}
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}

    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    kept = {}
    for i, t in sorted(texts.items()):
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeats = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        if len(w) < 20 or 100 * len(repeats) > 30 * len(w):
            continue
        s = shingles(w)
        if all(len(s & o) / len(s | o) < 0.8 for o in kept.values()):
            kept[i] = s
    want = {i for i in kept if item not in texts[i]}
    assert set(got) == want == {1, 4, 10, 11, 13, 14}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    for i in want:
        ids = enc.encode_ordinary(texts[i])
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def chunks_of(text):
    """Chunks of lines by the stated rule."""
    ls = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
    mark = [i >= 2 and (h[i - 2] * 31 + h[i - 1]) % 2 == 0 for i in range(len(ls))]
    starts = [0] + [i for i in range(1, len(ls)) if mark[i] and not mark[i - 1] and i < len(ls) - 1]
    return [ls[a:b] for a, b in zip(starts, [*starts[1:], len(ls)])]


def test_pipeline_of_many_lines_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 7))
    line = lambda n=12: " ".join(word() for _ in range(n))
    text = lambda n: "\n".join(line() for _ in range(n))
    foot, passage, item = text(2), text(9), line(30)
    rows = [(i, f"{text(4)}\n{foot}", "h") for i in range(30)]
    rows += [(30, f"{line()}\n{foot}", "h"), (31, rows[3][1], "h"), (31, text(5), "g"), (None, text(4), "g"), (None, text(3), "g")]
    rows += [(40, f"{text(3)}\n{passage}\n{text(2)}", "g"), (41, f"{text(4)}\n{passage}\n{text(3)}", "k"), (42, f"{text(3)}\n{line()} {item} {line()}", "k")]
    near = text(8)
    rows += [(50, near, "g"), (51, near.replace(near.split()[40], "other"), "k"), (52, None, "k"), (53, "", None), (54, "too few", "k"), (55, "same words again and again and more\n" * 20, "k"), (56, passage, "k"), (57, text(4), None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in P.run(spark, str(tmp_path)).collect())

    # quality: here every document has lines of its own, so distinct documents are distinct texts
    n_docs = Counter((s, x) for s, t in {(s, t) for _, t, s in rows if t} for x in set(t.split("\n")))
    hosts = Counter(s for s, _ in {(s, t) for _, t, s in rows})
    kept = []
    for i, t, s in rows:
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeats = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        left = [x for x in (t or "").split("\n") if n_docs[s, x] <= max(20, 0.02 * hosts[s])]
        n_left = len(" ".join(left).split())
        if len(w) >= 20 and 100 * len(repeats) <= 30 * len(w) and n_left >= 20 and n_left >= 0.5 * len(w):
            kept.append((i, "\n".join(left)))
    # line chunks: the first of (id, place) stays, no id first
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is not None, kept[r][0] or 0))
    first = {}
    for r in order:
        for c in chunks_of(kept[r][1]):
            first.setdefault("\n".join(c), r)
    seen, docs_left = set(), []
    for r in order:
        out = []
        for c in chunks_of(kept[r][1]):
            key = "\n".join(c)
            if len(c) == 1 or (first[key] == r and (r, key) not in seen):
                out.append(key)
            seen.add((r, key))
        if "".join(out).strip():
            docs_left.append((kept[r][0], "\n".join(out)))
    # near duplicates: one of each class of links, the least id, no id last
    words, similar = weighted_jaccard([t for _, t in docs_left])
    root = list(range(len(docs_left)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in combinations(range(len(docs_left)), 2):
        if words[i] == words[j] or similar(i, j) >= 0.8:
            root[find(j)] = find(i)
    best = {}
    for i, (k, t) in enumerate(docs_left):
        best[find(i)] = min(best.get(find(i), (True, 0, "~")), (k is None, k or 0, t))
    bad = {i for i, *_ in brute_overlaps(dict(enumerate(t for *_, t in best.values())), {1: item})}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    want = sorted((none, k, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for n, (none, k, t) in enumerate(best.values()) if n not in bad)
    assert got == want and {k for none, k, *_ in got if not none} >= {0, 29, 31, 40, 41, 50} and not {k for _, k, *_ in got} & {30, 42, 52, 54, 55} and sum(none for none, *_ in got) == 2
    empty = tmp_path / "empty"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, str(empty)).count() == 0
