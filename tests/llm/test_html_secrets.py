from cellgrid.llm import html_extract as H
from cellgrid.llm import secret_scan as S
from cellgrid.llm.html_training import labelled_pages
from cellgrid.llm.secret_training import labelled_findings


def test_blocks_are_labelled_well_on_held_out_pages():
    field, wrong, total = H.trained(), 0, 0
    for page, wanted in labelled_pages(80, 1234):
        blocks = H.leaf_blocks(page)
        labels = field.decode(H.block_features(blocks))
        wrong += sum(bool(on) != wanted(b.text) for b, on in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert wrong / total < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<!-- ad <p>x</p> --><div class="ad">Buy this now and save a lot of money.</div><article><h1>The  title &amp; more</h1><p>First&nbsp;paragraph of the <b>article</b>, with enough words to read.<br>After a break
it goes on.<p>Second paragraph isn&#39;t closed, and it has some words as well.<ul><li>An item of a list in the text<li>Another item of that list</ul>
<form><label>Mail</label><input><p>Sign up for our letters.</p></form></article><div class="comments"><p>I like this article very much!</p></div><footer>&copy; 2020 Somebody</footer>"""


def test_article_text():
    want = "The title & more First paragraph of the article, with enough words to read. After a break it goes on. Second paragraph isn't closed, and it has some words as well. An item of a list in the text Another item of that list"
    assert H.main_text(PAGE, H.trained()) == want


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    field = H.Field(rng.normal(size=(len(H.FEATURES), 2)), rng.normal(size=(2, 2)))
    rows = rng.normal(size=(7, len(H.FEATURES)))
    score = rows @ field.weight
    value = lambda y: sum(score[k, a] for k, a in enumerate(y)) + sum(field.pair[a, b] for a, b in itertools.pairwise(y))
    best = max(itertools.product((0, 1), repeat=7), key=value)
    assert tuple(field.decode(rows)) == best
    total = np.logaddexp.reduce([value(y) for y in itertools.product((0, 1), repeat=7)])
    assert abs(H.likelihood(field, rows, np.array(best))[0] - (value(best) - total)) < 1e-9


def test_pages_query(spark):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, None), (2, "u", "", "c"), (3, "u", "<p>", "c"), (4, "u", "<article>" + "<p>Many words stand here, one after the other.</p>" * 5000 + "</article>", "c"), (5, "u", "no markup at all <", "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in H.extract(frame).collect()}
    assert got[None] == got[2] == got[3] == "" and got[1].startswith("The title") and got[4].count("Many words") == 5000
    assert H.extract(frame).count() == 7 and H.extract(frame.limit(0)).count() == 0


def test_forest_on_held_out_findings():
    import numpy as np

    found = labelled_findings(800, 4321)
    score = S.trained().score(np.array([S.describe(*x[:4]) for x in found], float))
    assert ((score >= 0.5) == [x[4] for x in found]).mean() > 0.97


def test_secrets_query(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [
        (1, f'the token = "{key}" is set', "app.py"), (2, f"see commit {key} for the change", "CHANGELOG.md"), (3, "card 4111111111111111 of the order", None), (None, None, None), (4, "", "x"),
        (5, "id: 123e4567-e89b-12d3-a456-426614174000", "x"), (6, 'password = "your_api_key_here"', "docs/example.md"), (7, "word " * 60_000 + f'api_key="{key}"', ".env"), (1, f'the token = "{key}" is set', "app.py"), (8, "=" * 500_000, "x"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, candidates int")
    got = {r.doc_id: [(c.start, c.end) for c in r.candidates if c.score >= S.LEAST_SCORE] for r in S.scan(frame).collect()}
    assert S.scan(frame).count() == len(rows) and S.scan(frame.limit(0)).count() == 0
    assert got[1] == [(13, 53)] and len(got[7]) == 1
    assert not any(got[k] for k in (None, 2, 3, 4, 5, 6, 8))
    assert S.redact(rows[0][1], got[1]) == 'the token = "[SECRET]" is set'


def test_secrets_without_quotes_are_found_in_text():
    import numpy as np

    lines = {
        "DB_PASSWORD=hunter2Xk9q": "hunter2Xk9q", "password: S3cr3t!pass@word9, then": "S3cr3t!pass@word9", "pwd = aB3!kL9#mN2%qR": "aB3!kL9#mN2%qR", "secret=Abc123!Def456@Ghi7": "Abc123!Def456@Ghi7",
        "postgres://app:Tr0ub4dor@db/x": "Tr0ub4dor", "https://h/?token=9f86d081884c7d659a2feaa0c55ad015&user=12": "9f86d081884c7d659a2feaa0c55ad015", "<p>password: hunter2Xk9q</p>": "hunter2Xk9q",
    }
    forest = S.trained()
    for text, value in lines.items():
        spans, rows = S.scan_text(text, "")
        score = forest.score(np.array(rows, float))
        assert [text[a:b] for (a, b), s in zip(spans, score, strict=True) if s >= S.LEAST_SCORE] == [value], text
    for text in ("token: something of value", "password: required, at least", "password = request.getParameter(x)", "see https://example.com:8080/a@b"):
        spans, rows = S.scan_text(text, "")
        assert not spans or forest.score(np.array(rows, float)).max() < S.LEAST_SCORE, text
    hit = total = 0
    for before, value, after, _, label in labelled_findings(2000, 4321):
        if label:
            total += 1
            hit += (len(before), len(before) + len(value)) in S.candidates(before + value + after)
    assert hit / total > 0.97


def test_hidden_is_an_attribute_of_its_own():
    for raw in (' title="Hidden gems"', ' href="/the-hidden-cost"', " href=/the-hidden-cost", ' data-hidden="false"', ' aria-label="hidden"', ' alt="a hidden b" aria-hidden="false"', ' data-style="display:none"', ' title="style=display:none"'):
        assert not H.attributes(raw)[1], raw
    for raw in (" hidden", ' HIDDEN=""', ' class="x"hidden', " title='a' hidden/", ' style="color:red; display: none"', ' aria-hidden="true"'):
        assert H.attributes(raw)[1], raw
    assert H.attributes(' href="/?id=comments&class=ad" class="story body" id=Main')[0] == {"story", "body", "main"}
    assert H.attributes(' class="a" class="b"')[0] == {"a"}


def test_articles_that_speak_of_hidden_things_are_kept():
    body = "<p>First paragraph of the article, with enough words to read it all.</p><p><a href='/the-hidden-cost'>The cost</a> of the second paragraph is told here, in some more words, with <math><mi>x</mi><mo>+</mo><mn>1</mn></math> in it.</p>"
    want = "First paragraph of the article, with enough words to read it all. The cost of the second paragraph is told here, in some more words, with x+1 in it."
    for attribute in ("", ' data-hidden="false"', ' title="The hidden valley"'):
        assert H.main_text(f"<html><body><article{attribute}>{body}</article></body></html>", H.trained()) == want
    assert H.main_text(f"<html><body><article hidden>{body}</article></body></html>", H.trained()) == ""


def test_pages_of_any_shape_take_linear_time():
    import time

    shapes = ["<div>x", '<a "x', "<a ", "<a b='x", "<a b=\"x", "<b>x</i>", "<div class=k{}>", "</b>", "<p><b>", "<!--", "<script>", "&#1", "<", "<ul><li>x", "<a =", "<td>x<table>", "<a href='x'>y"]
    field = H.trained()
    for shape in shapes:
        page = "".join(shape.replace("{}", str(k)) for k in range(1_000_000 // len(shape)))
        for tail in ("", ">", "'\"> end"):
            began = time.time()
            H.main_text(page + tail, field)
            assert time.time() - began < 12, shape


def test_broken_markup():
    texts = lambda page: [b.text for b in H.leaf_blocks(page)]
    assert texts('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert texts('<p title="a>b">one</p>') == ["one"]
    assert texts("<p>1 < 2 &amp; 3 > 2</p>") == ["1 < 2 & 3 > 2"]
    assert texts("<p>a<b") == ["a<b"]
    assert texts("<p>&#" + "0" * 5000 + "65;&#" + "9" * 5000 + ";&#x1F600;</p>") == ["A�\U0001f600"]
    assert texts("<div><a>in</div>out</a> after") == ["in", "out after"]
    assert texts("<p>x<!-- never closed <p>y") == ["x"]
    assert texts("<title>t</title ><p>z") == ["z"]


def test_blocks_equal_a_plain_parser():
    """Texts by the standard library's parser on well-formed pages, cut at block elements."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [""], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in H.RAW
            self.out += [""] * (tag in H.BLOCK)
            if tag == "br" and not self.skip:
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.skip -= tag in H.RAW
            self.out += [""] * (tag in H.BLOCK)

        def handle_data(self, data):
            if not self.skip:
                self.out[-1] += data

    for page, _ in labelled_pages(60, 77):
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert [b.text for b in H.leaf_blocks(page)] == [t for x in plain.out if (t := " ".join(x.split()))]


JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"


def test_strings_written_by_hand():
    """Forms that the training generator does not write."""
    import numpy as np

    secrets = {
        "postgres://admin:S3cr3tPassw0rd@host/db": "S3cr3tPassw0rd", 'export PW="a1b2c3"': "a1b2c3", "api_key: k9Fz2Lq8Xw": "k9Fz2Lq8Xw", JWT: JWT, "Authorization: Bearer " + JWT: JWT, f"set token = {JWT};": JWT,
        "redis://:p4ssw0rd99@cache:6379": "p4ssw0rd99", "client_secret: 8f14e45fceea167a5a36dedd4bea2543": "8f14e45fceea167a5a36dedd4bea2543", "passwd: Tr0ub4dor&3xyz": "Tr0ub4dor&3xyz",
    }
    forest = S.trained()
    for text, value in secrets.items():
        spans, rows = S.scan_text(text, "")
        score = forest.score(np.array(rows, float))
        assert [text[a:b] for (a, b), x in zip(spans, score, strict=True) if x >= S.LEAST_SCORE] == [value], text
    for text in (
        "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "https://example.com/path/to/some-long-article-title-here-2020", "password: required, at least eight", "import java.util.concurrent.ConcurrentHashMap",
        "password = os.environ['DB_PASSWORD']", "api_key = config.get('api_key')", "secret=<your-secret-here>", "data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAUA", "id=123e4567-e89b-12d3-a456-426614174000",
    ):
        spans, rows = S.scan_text(text, "")
        assert not spans or forest.score(np.array(rows, float)).max() < S.LEAST_SCORE, text


def test_forest_equals_a_walk_row_by_row():
    """Flattened traversal against following each row through the same trees by itself."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows, labels = rng.normal(size=(200, 6)), rng.integers(0, 2, 200)
    forest = S.grow_forest(rows, labels, trees=7)
    for row, score in zip(rows, forest.score(rows), strict=True):
        shares = []
        for column, cut, left, share in zip(forest.column, forest.cut, forest.left, forest.share, strict=True):
            k = 0
            while left[k] != k:
                k = left[k] + int(row[column[k]] > cut[k])
            shares.append(share[k])
        assert abs(np.mean(shares) - score) < 1e-12


GERMAN = "Dieser Absatz erzählt in einigen Sätzen, was an jenem Tag geschah, und er ist lang genug, um gelesen zu werden."
SPANISH = "Este párrafo cuenta con bastantes palabras lo que pasó aquel día, para que se pueda leer sin prisa alguna."
JAPANESE = "この段落は、その日に起こったことをいくつかの文で語り、十分に長いので、ゆっくり読むことができます。"
OLD = "An old page holds its text in a table, and this paragraph is part of that text, of course."


def test_pages_of_other_hands_and_languages():
    """Layouts and class names that the training generator does not write."""
    pages = [
        (f"<html><body><div class='kopfzeile'><a href='/'>Start</a> <a href='/b'>Wetter</a> <a href='/c'>Sport</a></div><div class='inhalt'><h1>Ein Tag am See</h1>{f'<p>{GERMAN}</p>' * 4}</div><div class='fußzeile'><a href='/i'>Impressum</a> <a href='/d'>Datenschutz</a></div></body></html>", " ".join(["Ein Tag am See", *[GERMAN] * 4])),
        (f"<html><body><div id='menú-principal'><ul><li><a href='/'>Inicio</a></li><li><a href='/n'>Noticias</a></li></ul></div><div id='cuerpo'><h2>El río</h2>{f'<p>{SPANISH}</p>' * 3}<ul><li>Una cosa que se dice con algunas palabras.</li></ul></div><div id='pie'>© 2021 La Gaceta. <a href='/p'>Privacidad</a></div></body></html>", " ".join(["El río", *[SPANISH] * 3, "Una cosa que se dice con algunas palabras."])),
        (f"<html><body><div class='ナビ'><a href='/'>ホーム</a><a href='/2'>天気</a></div><div class='本文'><h1>湖の一日</h1>{f'<p>{JAPANESE}</p>' * 4}</div><div class='フッター'><a href='/k'>会社概要</a></div></body></html>", " ".join(["湖の一日", *[JAPANESE] * 4])),
        (f"<body><table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><h3>A title of old</h3>{f'<p>{OLD}' * 3}</td></tr></table></body>", " ".join(["A title of old", *[OLD] * 3])),
    ]
    for page, want in pages:
        assert H.main_text(page, H.trained()) == want
