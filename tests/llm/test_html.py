from recordloom.llm import html_wrappers as h


def page(title, paragraphs, extra="", close=True):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><ul><li><a href=/a>Menu</a><li>x</ul></nav><div class='ad top'>Buy</div><article><h1>{title}</h1>{body}{extra}</article><div id=comments><p>Nice!</p></div><form><p>Mail</p></form><footer>&copy;</footer>" + ("</body></html>" if close else "")


def test_article_text_by_blocks(spark):
    rows = [(i, f"https://u@Host.example:80/{i}", page(f"T{i} &amp; more", ["a  b\n c &lt;d&gt; &#233;", "<b>bold<br><p>open", ""], "<aside>not</aside><section class=share-tools>no</section>", i % 2 == 0), "x") for i in range(5)]
    rows += [(10, None, None, "x"), (11, "bad url", "", "x"), (12, "http://h/", "just < text & more", "x"), (0, rows[0][1], rows[0][2], "x")]
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert len(got) == len(rows)
    text = dict(zip(got.page_id, got.text))
    assert text[3] == "T3 & more\na b c <d> é\nbold\nopen"
    assert text[10] == "" and text[11] == "" and text[12] == "just < text & more"
    assert (got.n_chars == got.text.map(len)).all()


def test_wrapper_is_a_union_free_expression():
    w = None
    for n in (1, 3, 2):
        extra = "<table><tr><td>1<td>2<tr><td>3<td>4</table>" if n == 3 else ""
        one = h.infer(h.parse(page("t", ["x"] * n, extra)))
        w = one if w is None else h.merge(w, one)
    e = h.expression(w)
    assert "(<p>#text</>)+" in e and "(<table>" in e and "</>)?" in e and "|" not in e
    assert h.main_path(w) == ["html", "body", "article"]


def test_repeated_groups():
    w = h.infer(h.parse("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>"))
    assert h.expression(w["c"][0]) == "<dl>(<dt>#text</> <dd>#text</>)+</>"


def test_main_region_without_an_article():
    text = "<body><div class=header>Site</div><div class=wrap><div class=content><p>Long text of the page goes here.</p><p>And more of it, much more.</p></div><div class=sidebar>links</div></div></body>"
    assert h.read_page(text, None) == "Long text of the page goes here.\nAnd more of it, much more."


def test_empty(spark):
    assert h.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_deep_and_unclosed_pages_are_read():
    assert h.read_page("<article><p>ok" + "<b>" * 300 + "deep", None) == "okdeep"
    assert h.read_page("<article><p>a<!-- never closed", None) == "a"


def test_five_thousand_open_elements(spark):
    for tag in ("div", "font", "span"):
        one, two = (h.infer(h.parse("<article><p>ok" + f"<{tag}>{x}" * 5000)) for x in ("", "a"))
        assert h.expression(h.merge(one, two)).count(f"<{tag}") == 5000
    rows = [(1, "http://h/1", "<article><p>ok</p>" + "<div>" * 5000 + "deep"), (2, "http://h/2", "<article><p>fine</p></article>")]
    got = {r["page_id"]: r["text"] for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "ok\ndeep", 2: "fine"}


def test_every_layout_of_a_host_is_read(spark):
    prose = lambda i: f"Page {i} has quite a lot to say, in a sentence as long as this one is."
    rows = [(i, f"http://h/{i}", f"<body><article class=news><p>{prose(i)}</p></article></body>") for i in range(60)]
    rows += [(i, f"http://h/{i}", f"<body><article class=news><p>Teaser</p></article><main class=blog><p>{prose(i)}</p></main></body>") for i in range(60, 90)]
    rows += [(i, f"http://h/{i}", f"<body><article class=news></article><div class=old><p>{prose(i)}</p></div></body>") for i in range(90, 95)]
    rows += [(99, "http://h/99", f"<body><article class=news><p>{prose(99)}</p></article><article class=more><p>And {prose(99)}</p></article></body>")]
    got = {r["page_id"]: r["text"] for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(i) for i in range(95))
    assert got[99] == f"{prose(99)}\nAnd {prose(99)}"
    learned = h.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()
    assert len(learned) == 1 and "blog" in learned[0]["wrapper"] and "old" in learned[0]["wrapper"] and "more" in learned[0]["wrapper"]


def test_text_that_all_pages_share_is_template(spark):
    prose = lambda i: f"Seite {i} hat einiges zu sagen, in einem Satz, der so lang ist wie dieser hier."
    promo, werbung = "<p>Jetzt abonnieren!</p>", "<div class=werbung>Nur heute billig</div>"
    rows = [(i, f"http://h/{i}", f"<body><article><h1>T{i}</h1>{promo if i else ''}<p>{prose(i)}</p>{werbung if i % 3 else ''}<p>Ende {i % 5}</p></article></body>") for i in range(30)]
    rows += [(100 + i, "http://g/", f"<article><h2>T{i}</h2><p>{prose(0)}</p><p>{prose(1)}</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\n{prose(i)}\nEnde {i % 5}" for i in range(30))
    assert all(got[100 + i] == f"T{i}\n{prose(0)}\n{prose(1)}" for i in range(6))  # copies, no template
