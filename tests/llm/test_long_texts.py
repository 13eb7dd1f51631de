"""Texts of megabytes through the operators that read whole texts."""

import hashlib

import public_tokenizers

from quorumspark.llm import bpe, chat, curriculum, html, lines, minhash, quality, urls

WORDS = [f"w{i * 7919 % 100_003}" for i in range(300_000)]
TEXT = "\n".join(" ".join(WORDS[i : i + 12]) for i in range(0, len(WORDS), 12))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")


def test_near_duplicates_of_a_long_text(spark):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, TEXT, TEXT.replace(WORDS[1000], "other", 1), "a short one of six words")).collect()}
    assert got[0].class_id == got[1].class_id == 0 and got[0].n_links == 1 and got[2].class_id == 2


def test_figures_of_a_long_text(spark):
    r = quality.judged(docs(spark, TEXT)).first()
    assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(WORDS), sum(map(len, WORDS)), 0)


def test_tokens_of_a_long_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = bpe.digest(bpe.decode(bpe.encode(docs(spark, TEXT), path, public_tokenizers.PATTERN), path)).first()
    assert r.decoded_sha256 == hashlib.sha256(TEXT.encode()).hexdigest() and r.n_tokens > len(WORDS)


def test_pages_with_long_texts(spark):
    page = f"<html><body><nav>menu</nav><article><p>{TEXT}</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.io/1", page + '<link rel="canonical" href="http://b.net/2">')], "page_id long, url string, html string")
    assert html.main_text(pages).first().text == " ".join(TEXT.split())
    r = urls.filter_urls(pages).first()
    assert r.verdict == "block" and r.propagated


def test_lines_of_long_texts(spark):
    got = {r.doc_id: r for r in lines.repeated_chunks(docs(spark, TEXT, TEXT, "own line\n" + TEXT)).collect()}
    assert got[0].text == TEXT and got[0].n_removed == 0 and got[1].n_removed == 25_000 and got[2].text.startswith("own line") and got[2].n_removed > 24_900


def test_a_long_turn(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", TEXT + "</s>")], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_chats(rows)).first()
    assert r.loss_sha256 == hashlib.sha256((TEXT + "</s>").encode()).hexdigest() and r.loss_chars == len(TEXT) + 4


def test_a_long_document_in_the_mix(spark):
    got = {r.doc: r for r in curriculum.assign(docs(spark, TEXT, "short one")).collect()}
    assert got[0].size == len(WORDS) and got[0].taken + got[1].taken == (len(WORDS) + 2) * 3 // 2
