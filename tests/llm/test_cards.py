"""Articles that are cards of other stories, by what a host repeats."""

from quorumspark.llm import html


def test_cards_that_a_host_repeats_are_no_article(spark):
    card = lambda k, n: f'<article class="c"><a href="/{k}"><h3>Story {k} of this host</h3><p>' + " ".join(f"teaser{k}x{i}" for i in range(n)) + "</p></a></article>"
    shown = lambda k, n: [f"Story {k} of this host", " ".join(f"teaser{k}x{i}" for i in range(n))]
    prose = "<article><p>The same words of prose stand on two pages of this host and are no links</p></article>"
    own = lambda k: f"<article><h1>Head {k}</h1><p>" + " ".join(f"own{k}x{i}" for i in range(20)) + "</p></article>"
    rows = [
        (1, "http://h/1", own(1) + card(7, 20) + card(8, 2) + prose),
        (2, "http://h/2", own(2) + card(7, 20) + card(8, 2) + prose + card(9, 20)),
        (3, "http://h/3", card(7, 20) + card(8, 2)),  # nothing but cards: whole
        (4, "http://g/4", own(4) + card(7, 20)),  # one page of its host, in two copies
        (5, "http://g/4", own(4) + card(7, 20)),
    ]
    body = lambda k: [f"Head {k}", " ".join(f"own{k}x{i}" for i in range(20))]
    same = "The same words of prose stand on two pages of this host and are no links"
    want = {1: [*body(1), same], 2: [*body(2), same, *shown(9, 20)], 3: shown(7, 20) + shown(8, 2), 4: [*body(4), *shown(7, 20)], 5: [*body(4), *shown(7, 20)]}
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want
