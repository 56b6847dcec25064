"""Main text of pages with known articles: many templates, opaque templates, broken markup and edge rows."""

import random

import pytest

from ledgerline.llm import extraction as X

SENTENCE = "Der Rat hat in der Sitzung über die Kosten für das neue Haus der Stadt gesprochen und ist nicht zu einem Ergebnis gekommen"
ARTICLE = [f"{SENTENCE} {i}." for i in range(3)] + ["Ende.", f"{SENTENCE} – «A & B» <c>."]
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Punkt {i}</a></li>" for i in range(6)) + "</ul></nav>"
P = "".join(f"<p>{t.replace('&', '&amp;').replace('<', '&lt;').replace('«', '&laquo;').replace('»', '&#187;')}</p>" for t in ARTICLE)
COMMENT = f"<p>{SENTENCE}, sagt man.</p>"

TEMPLATES = {
    "plain": f"<html><head><title>T</title></head><body>{NAV}<article><h1>Titel</h1>{P}</article><footer>&copy; {SENTENCE}</footer></body></html>",
    "header and aside": f"<body><header><h1>Die Zeitung</h1><p>{SENTENCE}</p></header><main><article><header><h1>Titel</h1></header>{P}</article></main>"
                        f"<aside><p>{SENTENCE}</p></aside></body>",
    "names": f"<div id='cookieNotice'><p>{SENTENCE}</p></div><div class='top-menu'>Start | Ende</div><div class='content'><h1>Titel</h1>{P}</div>"
             f"<div class='side sidebar-right'><p>{SENTENCE}</p></div><div id=comments>{COMMENT}</div>",
    "form and notice": f"<article><h1>Titel</h1><div class=advert><p>{SENTENCE}</p></div>{P}<form><p>{SENTENCE}</p><input name=q><button>Los</button></form>"
                       f"<div role='alert'>{SENTENCE}</div></article>",
    "comments by heading": f"<article><h1>Titel</h1>{P}<section><h3>Kommentare (2)</h3><div>{COMMENT}</div>{COMMENT}</section></article>",
    "nested comments": f"<article><h1>Titel</h1>{P}<div class='comment-list'><article>{COMMENT}</article></div></article>",
    "unclosed": f"<body>{NAV}<article><h1>Titel</h1>{P.replace('</p>', '')}",
    "upper case": f"<BODY>{NAV.upper()}<ARTICLE><H1>Titel</H1>{P}</ARTICLE><FOOTER>{SENTENCE}</FOOTER>",
    "scripts": f"<article><script>if (a < b) document.write('</p><p>{SENTENCE}');</script><style>p > b {{}}</style><!-- <p>{SENTENCE}</p> --><h1>Titel</h1>"
               f"<noscript><p>{SENTENCE}</p></noscript>{P}<template><p>{SENTENCE}</p></template></article>",
    "hidden": f"<main><h1>Titel</h1>{P}<div style='display: none'><p>{SENTENCE}</p></div><p hidden>{SENTENCE}</p></main>",
    "page form": f"<form id=aspnet><div>{NAV}</div><article><h1>Titel</h1>{P}</article></form>",
    "opaque": f"<div class=a1><ul>{''.join(f'<li><a href=/>Punkt {i}</a></li>' for i in range(5))}</ul></div><div class=b2><h1>Titel</h1>{P}</div>"
              "<div class=c3><a href=/>Impressum</a> <a href=/>Kontakt</a></div>",
    "wrapper names": f"<div class='wrap sidebar'><article><h1>Titel</h1>{P}</article></div>",
    "attributes": f"<article data-x='a > b' title=\"it's\"><h1 class=x>Titel</h1>{P}</article><div class=\"ad\" onclick='a(\"</div>\")'>{SENTENCE}</div>",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    assert X.main_text(TEMPLATES[name]).split("\n") == ["Titel", *ARTICLE]


def test_second_pass_takes_the_nearest_neighbour():
    page = f"<div><p>Kurz A</p><p>{SENTENCE}</p><p>Kurz B</p></div><div><p>Kurz C</p><p><a href=/>{SENTENCE}</a></p></div>"
    assert X.main_text(page).split("\n") == ["Kurz A", SENTENCE, "Kurz B"]


def test_white_space_and_references():
    page = "<article><p>\n a&nbsp;\t<b>b</b>c <br>d &amp;amp; &#x41;&eacute;&notaref; 1 < 2 </p></article>"
    assert X.main_text(page) == "a bc d &amp; Aé&notaref; 1 < 2".replace("&notaref;", "¬aref;")


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a", "a"), ("<article>a<p>b</article", "a\nb"),
    ("<!-- open", ""), ("<article>x <script>never closed", "x"), ("<a <b <c", ""), ("</p></div></x>", ""),
])
def test_broken_pages(page, text):
    assert X.main_text(page) == text


def test_long_pages_take_linear_time():
    for junk in ("<" * 300_000, "<a " * 100_000, "<a x=\"" * 60_000, "<div>" * 60_000, "&" * 300_000, "<p><b>" * 60_000):
        X.main_text(junk + f"<article><p>{SENTENCE}</p></article>")


def test_rows(spark):
    rnd = random.Random(2)
    names = rnd.choices(list(TEMPLATES), k=30)
    data = [(i, f"u{i}", TEMPLATES[n], "x", 7) for i, n in enumerate(names)] + [(100, None, None, None, None), (100, None, None, None, None), (101, "u", "", "", 0)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, text string, n_chars int")
    got = X.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = "\n".join(["Titel", *ARTICLE])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(i, f"u{i}", want, len(want)) for i in range(30)] + [(100, None, "", 0)] * 2 + [(101, "u", "", 0)], key=repr)
    assert X.extract_main_text(df.limit(0)).count() == 0
