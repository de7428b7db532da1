import pytest

from trajecta.llm import html_text

PROSE = "The first of many words, set in a row; and then some more."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>only a menu</a></nav></body></html>", ""),
        (f"<p>{PROSE}", PROSE),
        (PROSE, PROSE),
        (f"<body><article><h1>A &amp; B</h1><p>{PROSE}<p>x<br>y  z</p>\n</article><footer>end, of page.</footer>", f"A & B\n{PROSE}\nx y z"),
        (f"<div id=main><p>{PROSE}</p><div class='ad box'><p>{PROSE}</p></div><p>Short.</p></div><div class=sidebar><p>{PROSE}</p></div>", f"{PROSE}\nShort."),
        (f"<main><p>{PROSE}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><ul><li>kept<li>too</ul><section id=comments><p>{PROSE}</p></section></main>", f"{PROSE}\nkept\ntoo"),
        (f"<!-- <p>no</p> --><script>var t='</p>{PROSE}';</script><style>p{{}}</style><article><p title='a > b'>{PROSE}</p><form><p>Your name, please.</p></form></article>", PROSE),
        (f"<article><p><b>{PROSE}<p>{PROSE} 1 &lt; 2 &am", f"{PROSE}\n{PROSE} 1 < 2 &am"),
        (f"<article><p>{PROSE}</p></div></b></x><p>after</p><p", f"{PROSE}\nafter"),
        (f"<article><p>{PROSE}</p><!-- cut off <p>x</p>", PROSE),
        (f"<body class='nav-open'><div><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"{PROSE}\n{PROSE}"),
    ],
)
def test_extract(page, want):
    assert html_text.extract(page) == want


def test_long_and_broken_pages_end():
    assert len(html_text.extract("<article><p>" + PROSE * 50_000)) == len(PROSE) * 50_000
    assert html_text.extract("<div>" * 30_000 + "<p>" + PROSE) == PROSE
    html_text.extract("<" * 20_000)
    html_text.extract("<a '" * 5_000)


def test_memory_and_time_of_deep_pages_are_linear():
    import time
    import tracemalloc

    page = "<div class=a>" * 100_000 + "<p>" + PROSE + "</i></x>" * 100_000
    tracemalloc.start()
    start = time.time()
    assert html_text.extract(page) == PROSE
    assert tracemalloc.get_traced_memory()[1] < 300e6 and time.time() - start < 60
    tracemalloc.stop()


@pytest.mark.parametrize(
    "inner,want",
    [
        (f'<p title="the hidden river">{PROSE}</p>', PROSE),
        (f'<p data-id="ad-1">{PROSE}</p>', PROSE),
        (f'<p aria-hidden="false">{PROSE}</p>', PROSE),
        (f"<p data-class='x' data-role=menu class=\"market-share\">{PROSE}</p>", PROSE),
        (f"<p>{PROSE}</p><ul><li><a href=1>Smith 2010</a></li></ul>", f"{PROSE}\nSmith 2010"),
        (f"<p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", f"{PROSE} x=2 holds."),
        (f"<header><h1>Head</h1></header><p>{PROSE}</p>", f"Head\n{PROSE}"),
        (f"<p>{PROSE}</p><table><tr><td>a<td>1<tr><td>b<td>2</table><object>Spare</object>", f"{PROSE}\na\n1\nb\n2\nSpare"),
        (f"<p>{PROSE}</p><p hidden>no</p><p style='display: none'>no</p><p class='ad'>no</p>", PROSE),
    ],
)
def test_attributes_are_names_with_values(inner, want):
    assert html_text.extract(f"<body><header>Site</header><article>{inner}</article></body>") == want


def test_paths_select_nodes_outside_of_main_elements():
    page = f"<body><div class=top>Welcome, guest</div><div class=t><span>12 pages</span></div><div class=text><p>{PROSE * 4}</p><p>{PROSE * 4}</p><ul><li>one<li>two</ul></div>"
    page += f"<h2>More</h2><div class=rest><p>{PROSE * 4}</p></div>" + "<div class=foot><div>About</div><div>Press</div><div>Jobs</div><div>Help</div></div>"
    assert html_text.extract(page) == f"{PROSE * 4}\n{PROSE * 4}\none\ntwo\nMore\n{PROSE * 4}"


def test_ratios_and_threshold_against_brute_force():
    """Everything recomputed from the rendered nodes of random pages, with plain sums."""
    import math
    import random

    rng = random.Random(5)
    for _ in range(40):
        nodes, page = [], "<body>"
        for _ in range(rng.randrange(1, 30)):
            kind = rng.choice(["div.a/p", "div.a/h2", "div.b/p", "ul/li", "p"])
            text = " ".join(rng.choice(["word", "longer", "x,", "end."]) for _ in range(rng.randrange(1, 25)))
            tags = [t.split(".") for t in kind.split("/")]
            page += "".join(f"<{t[0]} class={t[1]}>" if t[1:] else f"<{t[0]}>" for t in tags) + text + "".join(f"</{t[0]}>" for t in reversed(tags))
            nodes.append((f"body/{kind}", text))
        of = lambda p: [t for q, t in nodes if q == p]
        chars = [sum(len(t) for t in of(p)) / len(of(p)) for p, _ in nodes]
        marks = [1 + sum(t.count(",") + t.count(".") for t in of(p)) / len(of(p)) for p, _ in nodes]

        def smooth(values, i):
            some = [(math.exp(-(k * k) / 2), values[i + k]) for k in (-2, -1, 0, 1, 2) if 0 <= i + k < len(values)]
            return sum(w * v for w, v in some) / sum(w for w, _ in some)

        fused = [math.sqrt(smooth(chars, i) * smooth(marks, i)) for i in range(len(nodes))]
        mean = sum(fused) / len(fused)
        own = [math.sqrt(c * m) for c, m in zip(chars, marks, strict=True)]
        best = {p: min(own[i], max(f for (q, _), f in zip(nodes, fused, strict=True) if q == p)) for i, (p, _) in enumerate(nodes)}
        threshold = min(0.5 * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(best.values()))
        parsed = html_text.parse(page)
        paths, got = html_text.content_paths(parsed)
        assert math.isclose(got, threshold, abs_tol=1e-9)
        assert {parsed.full_path(p) for p in paths} == {p for p, f in best.items() if f >= got}


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}é</p></article>", 1), (None, None, None, 2), (1, "u", f"<article><p>{PROSE}é</p></article>", 1)], "page_id long, url string, html string, text int")
    rows = html_text.main_text(df).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "u", PROSE + "é", len(PROSE) + 1)] * 2 + [(None, None, "", 0)], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div><div>{PROSE * 6}</div><div>{PROSE}</div></div></body>", f"{PROSE * 6}\n{PROSE}"),
        (f"<body><div><div class=a><h2>Head</h2><p>{PROSE * 6}</p></div><div class=b><p>{PROSE}</p></div></div></body>", f"Head\n{PROSE * 6}\n{PROSE}"),
        (f"<main><article>{PROSE * 3}</article><section>{PROSE * 2}</section></main>", f"{PROSE * 3}\n{PROSE * 2}"),
        (f"<body><article><p>{PROSE * 3}</p></article><article><p>{PROSE * 2}</p></article></body>", f"{PROSE * 3}\n{PROSE * 2}"),
        (f"<body><article><p>{PROSE * 3}</p></article><section><p>{PROSE * 2}</p></section></body>", f"{PROSE * 3}\n{PROSE * 2}"),
        (f"<article><p>{PROSE}</p><ol><li><a href=1>Smith, J. (2010). On the many words.</a><li><a href=2>Of words and of rows</a>, 2nd ed.</ol></article>", f"{PROSE}\nSmith, J. (2010). On the many words.\nOf words and of rows, 2nd ed."),
        (f"<div><p>{PROSE}</p><ul><li><a href=1>Home</a><li><a href=2>About us</a></ul><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
    ],
)
def test_no_part_of_the_content_is_cut(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div class='layout has-sidebar'><p>{PROSE}</p></div></body>", PROSE),
        (f"<div id='content-with-nav'><p>{PROSE}</p></div>", PROSE),
        (f"<main class='no-comments'><p>{PROSE}</p></main>", PROSE),
        (f"<article class='post social-science'><p>{PROSE}</p></article>", PROSE),
        (f"<main class='search'><h1>Head</h1><div class='search-results'><p>{PROSE}</p></div></main>", f"Head\n{PROSE}"),
        (f"<body><div class='right sidebar'><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"{PROSE}\n{PROSE}"),
        (f"<body><form action=x><main><h1>Head</h1><p>{PROSE}</p></main></form></body>", f"Head\n{PROSE}"),
        (f"<body><main><h1>Head</h1><form><p>{PROSE}</p></form></main></body>", f"Head\n{PROSE}"),
        (f"<article><p>{PROSE}</p><section id=comments><p>{PROSE * 9}</p></section><div class='cookie-banner'>{PROSE}</div></article><div class='site-footer'>{PROSE}</div>", PROSE),
        (f"<div><p>{PROSE * 2}</p><div class='ad-slot'>{PROSE}</div><div hidden>{PROSE}</div></div>", PROSE * 2),
    ],
)
def test_names_and_forms_around_the_content_do_not_empty_a_page(page, want):
    assert html_text.extract(page) == want
