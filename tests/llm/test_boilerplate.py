import numpy as np

from termforge.llm.boilerplate import article, articles, furniture, furniture_lines, smoothed, threshold

PAGE = """Skip to content
Home | News | Shop | FAQ | Contact

You are here: Home » Bees
We use cookies to give you the best experience.
Accept all cookies | Reject | Settings
Trending on Wikilume
- Cold queens and the tamine
How keepers carry veils
The old hives of the valley held more honey than anyone had expected this year.
Events
It takes two days for the combs to settle. Nobody knew why the keepers needed more veils.
- gentle recipes
- narrow combs
Advertisement
name | weight | price
queen | 3 | 4
Most of the meadows we saw were dry, yet the bees stayed calm and fed the young brood.
Share this: Chirper Facegram Mailbox
Related articles
Quiet mechanics in Dunhalt
1 2 3 4 5 … 12 >
© 2012 Wikilume. All rights reserved.
Terms
Privacy
Cookies"""
KEPT = {10, 11, 12, 13, 14, 16, 17, 18}


def test_a_page():
    lines = PAGE.split("\n")
    expected = [i for i, x in enumerate(lines, 1) if x.strip() and i not in KEPT]
    assert furniture(PAGE) == expected
    assert article(PAGE).split("\n") == [x for i, x in enumerate(lines, 1) if i in KEPT or not x.strip()]


def test_garbled_and_foreign_furniture():
    text = "Produits | ActualitÃ©s | Ã€ propos\nLes élèves précèdent la dernière étape malgré le coût élevé de cette année.\nÀ lire aussi\n› Les abeilles, la grande fête\n© 2011 Zakadufex – Tous droits réservés\nMentions légales | Confidentialité"
    assert furniture(text) == [1, 3, 4, 5, 6]


def test_markup_counts_as_tags():
    text = "<nav><a href='/'>Home</a> <a href='/n'>News</a></nav>\n<p>A long paragraph of running text about hives and honeys that nobody links to.</p>\n<p>Another long paragraph, also without a single link, about the same hives.</p>\n© 2020 Bees"
    assert 4 in furniture(text) and 2 not in furniture(text)


def test_smoothing_and_threshold():
    values = np.array([1, 1, 1, 90, 100, 2, 95, 90, 1, 1], float)
    s = smoothed(values)
    assert len(s) == len(values) and s[5] > threshold(s) > s[0]
    assert threshold(np.array([])) == 0 and threshold(np.array([3.0, 3.0])) == 3


def test_edges():
    for text in (None, "", " \n\t\n", "One line of prose only.", "\n\n"):
        assert furniture(text) == []
    assert article(None) is None and article("") == ""
    assert furniture(("A sentence about bees and hives. " * 30 + "\n") * 200) == []


PROSE = "The old hives of the valley held more honey than anyone had expected this year. Nobody knew why."
TEASERS = ["› Cold queens in Dunhalt", "Quiet mechanics", "3. How keepers carry veils", "- Damp combs explained", "Northern bees and hives", "Rare swarms in Asterby", "› Late honey", "Steady keepers of Wexmoor"]


def test_long_lists_of_teasers():
    assert furniture("\n".join([PROSE, "Related articles", *TEASERS])) == list(range(2, 11))
    # the page's own title ends a list, with words put in too
    for title in ("Queens and meadows", "Queens and Foobar meadows"):
        assert furniture("\n".join(["Most read", *TEASERS, title, PROSE]), "Queens and meadows") == list(range(1, 10))
    # so does what only an untitled page's own text has, a heading set apart, a table and prose of short lines
    assert furniture("\n".join(["Most read", *TEASERS, "All about pendrakol", PROSE, PROSE + " Pendrakol is pendrakol."])) == list(range(1, 10))
    assert furniture("\n".join(["Most read", *TEASERS, "", "What the keepers did next", PROSE]), "Bees") == list(range(1, 10))
    assert furniture("\n".join(["Most read", *TEASERS, "name | weight | price", "queen | 3 | 4"])) == list(range(1, 10))


def test_regions_of_unknown_words():
    # rows of links, navigation and footers in other languages, told by their tags; headings and links in prose stay
    items = ["<li><a href='/a'>Etusivu</a></li>", "<li><a href='/b'>Uutiset ja sää</a></li>", "<li><a href='/c'>Kauppa</a></li>", "<li><a href='/d'>Yhteys</a></li>"]
    text = ["<ul>", *items, "</ul>", "<h1>Mehiläiset</h1>", f"<p>{PROSE}</p>", f"<p>{PROSE} <a href='/e'>Lisää</a></p>", f"<p>{PROSE}</p>", "<footer>", "<p>Mehiläisseura, Oulu</p>", "</footer>"]
    assert furniture("\n".join(text)) == [1, 2, 3, 4, 5, 6, 11, 12, 13]
    assert furniture("\n".join([PROSE * 3, PROSE * 3, "<nav>", PROSE * 3])) == []
    # plain text: a row of short entries, but no table
    assert furniture("\n".join(["Etusivu | Uutiset | Kauppa | Yhteys | Ohje", PROSE, PROSE, PROSE])) == [1]
    assert furniture("\n".join([PROSE, PROSE, "bee | hive | comb | queen", "one |  | n/a | "])) == []


def test_long_lines_of_furniture():
    menu = " | ".join(["Home", "News", "Shop", "Products", "About us", "Contact", "FAQ", "Log in", "Register", "Search", "Sitemap", "Careers"] * 4)
    notice = "We use cookies to give you the best experience. " + "Some cookies are needed for the pages that you visit. " * 8
    assert len(menu) > 300 < len(notice)
    assert furniture("\n".join([menu, notice, PROSE, "I baked cookies all day. " + PROSE * 4])) == [1, 2]


def test_rows(spark):
    rows = [("a", PAGE, "x"), ("a", PAGE, "x"), ("b", None, "x"), ("c", "", "x")]
    df = spark.createDataFrame(rows, "line_no string, article string, title string")
    found = furniture_lines(df, "line_no", "article")
    assert found.count() == len(furniture(PAGE)) and {r["record"] for r in found.collect()} == {"a"}
    got = {(r["record"], r["article"] is None) for r in articles(df, "line_no", "article", "title").collect()}
    assert got == {("a", False), ("b", True), ("c", False)}
    assert furniture_lines(df.limit(0), "line_no", "article").count() == 0


def _site(n, foot="Kaikki oikeudet pidätetään"):
    """Pages of one site without any word that a list has: a menu in single lines, an article, a list of titles and a footer."""
    pages = []
    for i in range(n):
        own = "".join("abcdefghij"[int(c)] * 2 for c in f"{i:03}")
        article_ = [f"Hunajasta ja {own}", f"Mehiläiset {own} kantoivat hunajaa koko päivän eikä kukaan tiennyt miksi niin kävi.", "Tausta", f"Toinen kappale {own} kertoo pesistä ja kehyksistä, joita oli enemmän kuin ennen."]
        titles = [f"› Juttu pesästä {own} tänään", f"› Miten {own} hoidetaan kotona"]
        pages.append((f"d{i}", article_[0], "\n".join(["Etusivu", "Uutiset", "Kauppa", *article_, "Lue myös nämä", *titles, f"{foot} 20{i % 10}0"]), "www.pesa.test"))
    return pages


def test_what_recurs_needs_no_words(spark, monkeypatch):
    from termforge.llm import boilerplate

    df = spark.createDataFrame(_site(30), "docid string, title string, body string, site string")
    found = {(r["record"], r["line_no"]) for r in furniture_lines(df, "docid", "body", "title", "site").collect()}
    assert found == {(f"d{i}", n) for i in range(30) for n in (1, 2, 3, 8, 9, 10, 11)}  # and the subhead that recurs amid paragraphs stays
    # beyond the size for the tasks the parts are joined by shuffle: same rows
    monkeypatch.setattr(boilerplate, "MOST_PARTS", 1)
    assert {(r["record"], r["line_no"]) for r in furniture_lines(df, "docid", "body", "title", "site").collect()} == found


def test_the_threshold_decides_every_line(monkeypatch):
    from termforge.llm import boilerplate

    assert furniture(PAGE)
    monkeypatch.setattr(boilerplate, "MOST_CUT", -1.0)
    assert furniture(PAGE) == []
    monkeypatch.setattr(boilerplate, "MOST_CUT", 9.0)
    monkeypatch.setattr(boilerplate, "LEAST_CUT", 9.0)
    assert len(furniture(PAGE)) == sum(bool(x.strip()) for x in PAGE.split("\n"))


def test_copies_make_nothing_recur(spark):
    page = _site(1)[0]
    df = spark.createDataFrame([(f"c{i}", *page[1:3], f"site{i % 40}.test") for i in range(400)], "docid string, title string, body string, site string")
    assert furniture_lines(df, "docid", "body", "title", "site").count() == 0


def test_markup_without_known_words():
    text = ["<div><a href='/a'>Etusivu</a></div>", "<div><a href='/b'>Uutiset</a></div>", "<div><a href='/c'>Kauppa</a></div>", f"<p>{PROSE}</p>", f"<p>{PROSE}</p>", "<div>Copyright 2020</div>"]
    assert furniture("\n".join(text)) == [1, 2, 3, 6]
