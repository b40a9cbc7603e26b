"""Template deduction on hosts whose tags say nothing, with repeated rows, several layouts and copies."""

import random

import duckdb

from strandspark.llm import html


def running(i, n=20):
    rng = random.Random(i)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def extract(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    return sorted([(r.page_id, r.text) for r in html.extract_main_text(df).collect()], key=str)


def neutral(i, paragraphs=3):
    """A page with divs of unspeaking names; its title, paragraphs and list are data."""
    text = [running(i * 101 + k) for k in range(paragraphs + i % 3)]
    links = "".join(f"<li><a href='/{k}'>{running(i * 31 + k, 2)}</a></li>" for k in range(4))
    page = f"<html><body><div class='x1'><p>Home of things</p></div><div class='x9'><ul>{links}</ul></div><div class='x2'><h1>Title {i}</h1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class='x3'><p>{'Printed on paper, all rights are ours. ' * 9}</p></div></body></html>"
    return page, " ".join([f"Title {i}", *text])


def test_slots_without_speaking_tags(spark):
    made = [neutral(i) for i in range(8)]
    got = extract(spark, [(i, f"http://h.example/{i}", m[0]) for i, m in enumerate(made)])
    assert got == [(i, m[1]) for i, m in enumerate(made)]


def test_repeated_rows_change_nothing(spark):
    made = [neutral(i) for i in range(6)]
    rows = [(i, f"http://h.example/{i}", m[0]) for i, m in enumerate(made)]
    want = [(i, m[1]) for i, m in enumerate(made)]
    assert extract(spark, rows * 2) == sorted(want * 2, key=str)
    assert extract(spark, rows + rows[:1] * 40 + [(None, *r[1:]) for r in rows[:2]]) == sorted(want + want[:1] * 40 + [(None, w[1]) for w in want[:2]], key=str)


def test_one_page_often_is_no_template(spark):
    page, text = "<body><div><p>some words of a page</p><p>and more</p></div></body>", "some words of a page and more"
    assert extract(spark, [(i, "http://h.example/", page) for i in range(9)]) == [(i, text) for i in range(9)]


def test_several_layouts_of_a_host(spark):
    pages, want = [], []
    for i in range(24):
        kind, text = i % 4, running(i, 40)
        pages.append((i, f"http://h.example/{i}", f"<body><section class='q{kind}'><div class='t{kind}'>Part {kind} of the house</div><div class='u{kind}'><p>{text}</p></div><div class='v{kind}'>End of part {kind}</div></section></body>"))
        want.append((i, text))
    assert extract(spark, pages) == sorted(want, key=str)


def test_copies_are_no_template(spark):
    """Pages of one text in an odd element of its own: their common text is no template."""
    body = running(1, 200)
    odd = [(i, f"http://h.example/{i}", f"<body><article><h1>Title {i}</h1><p>{running(i)}</p></article></body>") for i in range(10)]
    same = [(100 + i, f"http://h.example/c{i}", f"<body><article><h1>Copy {i}</h1><blockquote><p>{body}</p></blockquote></article></body>") for i in range(4)]
    got = dict(extract(spark, odd + same))
    assert all(got[100 + i] == f"Copy {i} {body}" for i in range(4)) and got[3] == f"Title 3 {running(3)}"


def test_fixed_texts_in_articles_go_and_both_articles_stay(spark):
    page = lambda i: f"<body><nav>menu</nav><article><h1>T {i}</h1><p>{running(i, 60)}</p><div class='z'>Tell your friends</div></article><article><p>{running(-i - 1, 5)}</p></article><footer>f</footer></body>"
    got = extract(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(5)])
    assert got == [(i, f"T {i} {running(i, 60)} {running(-i - 1, 5)}") for i in range(5)]


def test_order_and_nesting_are_checked():
    tag = lambda key, place, kind: {"cls": 1 if key < 10 else 2, "place": place, "key": key, "kind": kind, "element": key, "depth": 1, "once": True, "rows": 5}
    t = html.Template([tag(1, 0, 1), tag(2, 5, 2), tag(11, 2, 1), tag(12, 8, 2)], None)
    lay = lambda *keys: html.Overlay(t, [(k, 1) for k in keys])
    assert lay(1, 2, 1, 2).ordered == {1} and lay(2, 1).ordered == set() and lay(1, 1, 2, 2).bad[1] == 1
    over = lay(1, 11, 12, 2)
    assert [over.step(k) for k in (1, 11, 12, 2)] == [(1, 0), (2, 0), (2, 1), (1, 1)] and not over.bad and over.parents == {(1, 0, -1): 1, (2, 1, 0): 1}
    over = lay(1, 11, 2, 12)
    assert [over.step(k) for k in (1, 11, 2, 12)] and sum(over.bad.values()) == 1


def test_long_fixed_texts_go(spark):
    long = "All of this stands on every page of the house. " * 30
    pages = [(i, f"http://h.example/{i}", f"<body><div class='a1'>{long}</div><div class='a2'><p>{running(i, 300)}</p></div></body>") for i in range(5)]
    assert extract(spark, pages) == [(i, running(i, 300)) for i in range(5)]


def test_agrees_with_sql_without_the_article(spark, sf):
    """What is left when the parts around it are cut away by expression is what the slots hold."""
    sql = r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?s)<head>.*?</head>|<nav>.*?</nav>|<div class="ad">.*?</div>|<footer>.*?</footer>|<!--.*?-->', ' ', 'g'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text from read_parquet('%s/pages.parquet')"""
    want = duckdb.sql(sql % sf).fetchall()
    plain = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div>'), '</article>', '</div>') as html")
    got = [(r.page_id, r.text) for r in html.extract_main_text(plain).collect()]
    assert sorted(got) == sorted(want)
