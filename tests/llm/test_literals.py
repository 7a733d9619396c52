"""Blocks that a host's pages nearly all have, found before neighbouring texts become one slot."""

import random

from parcelwise.llm import html


def prose(rng):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(25))


def test_a_block_between_paragraphs_that_every_page_has(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(12):
        own = [prose(rng) for _ in range(rng.randint(2, 5))]
        place = rng.randint(0, len(own))
        blocks = [*own[:place], "Subscribe to our newsletter today for free", *own[place:]]
        rows.append((k, "http://one.example/a", f"<body><main><h1>Title {k}</h1>{''.join(f'<p>{b}</p>' for b in blocks)}<div class='related-articles-box'><p>{prose(rng)}</p></div></main></body>"))
        want[k] = " ".join([f"Title {k}", *own])
    # versions of one text: most of it is on all pages, so nothing of it is taken for the host's own
    shared = [prose(rng) for _ in range(4)]
    for k in range(20, 32):
        blocks = [*shared, prose(rng)]
        rng.shuffle(blocks)
        rows.append((k, "http://versions.example/a", f"<body><main>{''.join(f'<p>{b}</p>' for b in blocks)}</main></body>"))
        want[k] = " ".join(blocks)
    rows += [(40, "http://none.example", None), (40, "http://none.example", None), rows[0]]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows) and all(r.text == want.get(r.page_id, "") and r.n_chars == len(r.text) for r in got)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
