"""BPE, HTML and quotes."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import sha
from samples import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, html_extract, quote_linking

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.BatchCoder(bpe.ByteBPE(PATH))


def test_encoding_equals_the_library(odd, empty, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(odd, PATH, digests=True).collect())
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(library.decode(ids, skip_special_tokens=False)), tuple(ids)))
    assert got == sorted(want)
    assert bpe.encode(empty, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text_round_trips(coder, library, texts):
    for t, ids in zip(texts, coder(texts), strict=True):
        assert list(ids) == library.encode(t, add_special_tokens=False).ids
        assert coder.bpe.decode(ids).decode() == t


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab <|endoftext>\n", max_size=80))
def test_special_tokens_in_text(coder, library, text):
    assert list(coder([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_decode_frame(spark):
    df = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None)], "k long, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).orderBy("k").collect()] == ["Hello world", "", None]


PAGES = [
    ("<html><body><nav><ul><li><a href=1>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  para\nof text.<p>Second <b>para</b> &eacute;.</article><footer>&copy; x</footer></body></html>", "Title & more First para of text. Second para é."),
    ("<body><header><h1>Site</h1></header><main><h1>T</h1><p>Some words of content that are quite many in number here.</p><form><label>Name</label></form><aside>Side</aside><section class='comments'><p>Reader comment text</p></section></main></body>", "T Some words of content that are quite many in number here."),
    ("<div class='cookie-notice'>We use cookies</div><div><p>Real text of the page with enough words to be the article of it.</p><p>Short.</p></div><div id=sidebar><p>Other things to read</p></div>", "Real text of the page with enough words to be the article of it. Short."),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes, this is it &lt;really&gt;</p><!-- no -->", "yes, this is it <really>"),
    ("<article>open <b>and never closed <p>para", "open and never closed para"),
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav>", ""),
    ("plain words", "plain words"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<html><head><meta charset=utf-8><title>T</title><script>var x</script><body><article><p>The whole article stands here.</p></article></body></html>", "The whole article stands here."),
        ("<html><head><title>T</title><p>No body tag either.</p></html>", "No body tag either."),
        ("<head><title>T</title><img src=a>Text after an image.", "Text after an image."),
        ("<head><title>T</title>\n bare text", "bare text"),
        ("<head><noscript><p>hidden</p></noscript><template><p>hidden</p></template></head><p>shown</p>", "shown"),
    ],
)
def test_head_may_be_left_open(html, text):
    assert html_extract.main_text(html) == text


LONG = "A paragraph of the article with a good many words in it so that its ratio is high enough."


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><p>" + LONG + "</p><h2>References</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul></article>", LONG + " References First source Second source"),
        ("<article><p>" + LONG + "</p><p class='legal'>The law says so.</p><p class='story-search'>The search went on.</p></article>", LONG + " The law says so. The search went on."),
        ("<article><p>" + LONG + " <math><mi>x</mi></math> is a number.</p></article>", LONG + " x is a number."),
        ("<article><p>" + LONG + "</p><div class='ad'>Buy this now and here</div><section id='comments'><article class='comment'><p>" + LONG + "</p></article></section></article>", LONG),
    ],
)
def test_text_of_articles_is_kept(html, text):
    assert html_extract.main_text(html) == text


MENU = "<div>" + "".join(f"<div><a href='/{k}'>Link {k}</a></div>" for k in range(8)) + "</div>"
BARE = [
    (MENU + f"<div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<table><tr><td>{MENU}</td><td><p>{LONG}</p><p>Short.</p><p>{LONG}</p></td></tr></table>", f"{LONG} Short. {LONG}"),
    (MENU + f"<div>{LONG}</div><div>{LONG}</div><div>Yes.</div><div>{LONG}</div><div>{LONG}</div>" + MENU, f"{LONG} {LONG} Yes. {LONG} {LONG}"),
]


@pytest.mark.parametrize("html,text", BARE)
def test_pages_without_article_tags_or_class_names(html, text):
    assert html_extract.main_text(html) == text


def test_ratios_smoothing_and_threshold_decide(monkeypatch):
    page = f"<nav><a>m</a></nav><div class='ad'>{LONG}</div><article><h1>T</h1><p>{LONG}</p></article>"
    assert html_extract.main_text(page) == f"T {LONG}"
    whole = [html_extract.main_text(h) for h, _ in BARE]
    with monkeypatch.context() as m:
        m.setattr(html_extract, "threshold", lambda x: -np.inf)
        assert html_extract.main_text(page) == f"{LONG} T {LONG}"
        assert all(html_extract.main_text(h) != t for (h, _), t in zip(BARE, whole, strict=True))
    with monkeypatch.context() as m:
        m.setattr(html_extract, "smooth", lambda x: x)
        assert html_extract.main_text(BARE[2][0]) != whole[2]


def test_smoothing_and_threshold_equal_plain_loops():
    g = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        x = g.random(n) * 6
        k = [[np.exp(-0.5 * ((i - j) / html_extract.SIGMA) ** 2) if abs(i - j) <= 5 else 0 for j in range(n)] for i in range(n)]
        assert np.allclose(html_extract.smooth(x), [sum(a * b for a, b in zip(row, x, strict=True)) / sum(row) for row in k])
    x = np.r_[g.random(30), 4 + g.random(20)]
    cut = min(((x[x > c].var() * (x > c).sum() + x[x <= c].var() * (x <= c).sum(), c) for c in sorted(x)[:-1]))[1]
    assert ((x > html_extract.threshold(x)) == (x > cut)).all()


def test_extract_frame(spark):
    rows = [(k, None if k % 2 else "u", h, "clash") for k, (h, _) in enumerate(PAGES * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    assert got == [(k, t, len(t)) for k, (_, t) in enumerate(PAGES * 2)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_long_page():
    body = " ".join(f"<p>word{k} text of a paragraph</p>" for k in range(20_000))
    assert html_extract.main_text(f"<article>{body}</article>").count("paragraph") == 20_000


MESSAGES = [
    (1, 0, "user", "Hello there my friend\nhow are you today"),
    (1, 1, "assistant", "> how are you today\nFine thanks to you"),
    (1, 2, "user", "On Monday X wrote:\n>> how are you today\n> Fine thanks to you\nGood to hear"),
    (2, 0, "user", "> Good to hear\nme too"),
    (2, 1, "user", None),
    (2, 2, "user", "> unknown words here\n>\n> x"),
    (3, 0, None, "Good to hear"),
    (None, 3, "user", "> Good to hear"),
    (3, None, "user", ""),
    (1, 2, "user", "On Monday X wrote:\n>> how are you today\n> Fine thanks to you\nGood to hear"),
]


def test_quotes_are_linked_and_removed(spark):
    df = spark.createDataFrame([(*m, "x") for m in MESSAGES], "conv_id long, turn long, role string, text string, hash string").repartition(3)
    got = {(r.conv_id, r.turn): r for r in quote_linking.chat_format(df).collect()}
    parent = {k: (r.parent_conv_id, r.parent_turn) for k, r in got.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 2), (2, 1): (None, None), (2, 2): (None, None), (3, 0): (None, None), (None, 3): (None, None), (3, None): (None, None)}
    assert got[1, 2].text == "Good to hear" and got[1, 2].quoted == 2 and got[1, 2].n_quotes == 2
    thread = [(r.conv_id, r.turn) for r in sorted((r for r in quote_linking.chat_format(df).collect() if r.thread_id == 1), key=lambda r: r.position)]
    assert thread == [(1, 0), (1, 1), (1, 2), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert quote_linking.chat_format(df.limit(0)).count() == 0


def test_nested_quotes_are_linked(spark):
    rows = [(1, 0, "user", "shall we meet on Monday"), (1, 1, "user", "> shall we meet on Monday\nYes"), (1, 2, "user", "> Yes\n>> shall we meet on Monday\nGood then we will"), (1, 3, "user", "> Good then we will\n>> Yes\n>>> shall we meet on Monday\nSee you"), (2, 0, "user", ">>> See you\nfrom afar")]
    got = {(r.conv_id, r.turn): r for r in quote_linking.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.parent_conv_id, r.parent_turn, r.n_linked) for k, r in got.items()} == {(1, 0): (None, None, 0), (1, 1): (1, 0, 1), (1, 2): (1, 1, 2), (1, 3): (1, 2, 3), (2, 0): (1, 3, 1)}
    assert {k: [tuple(x) for x in r.links] for k, r in got.items()} == {(1, 0): [], (1, 1): [(1, 1, 0, 1)], (1, 2): [(1, 1, 1, 1), (2, 1, 0, 1)], (1, 3): [(1, 1, 2, 1), (2, 1, 1, 1), (3, 1, 0, 1)], (2, 0): [(3, 1, 3, 1)]}


def plain_link(rows):
    """(n_linked, parent) of each (conv, turn, text) row, from all pairs of messages."""
    norm = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip()
    parts = lambda t: {x for p in ([t, *t.split("\n")] if "\n" in t.strip() else [t]) if (x := norm(p))}
    own = [parts(quote_linking.parse(t)[0]) for _, _, t in rows]
    out = []
    for c, t, text in rows:
        levels = {}
        for level, p in quote_linking.parse(text)[1]:
            for x in parts(p):
                levels[x] = min(levels.get(x, 99), level)
        votes = Counter()
        for x, level in levels.items():
            said = [(c2, t2) for (c2, t2, _), o in zip(rows, own, strict=True) if x in o and c2 is not None and t2 is not None]
            near = [t2 for c2, t2 in said if c2 == c]
            if c is None or t is None:
                continue
            if near and min(near) < t:
                votes[level, (c, min(near))] += 1
            elif said and " " in x and min(said) < (c, t):
                votes[level, min(said)] += 1
        best = {(-level, at[0] == c, n, at[1]): at for (level, at), n in votes.items()}
        tied = [at for (level, at), n in votes.items() if (-level, at[0] == c, n, at[1]) == max(best)] if best else []
        out.append((sum(votes.values()), set(tied) or {(None, None)}))
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_links_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(quote_linking, "HOT", hot)
    g = np.random.default_rng(8)
    said, rows = ["yes", "no way", "see you there", "shall we meet", "on Monday then"], []
    for k in range(120):
        lines = []
        for _ in range(int(g.integers(0, 4))):
            lines.append(">" * int(g.integers(1, 4)) + " " + str(g.choice(said)))
        lines.insert(0, "Ann wrote:") if lines and g.random() < 0.5 else None
        lines += [str(g.choice(said)) + (f" {g.integers(4)}" if g.random() < 0.7 else "") for _ in range(int(g.integers(0, 3)))]
        rows.append((int(g.integers(6)) if k % 17 else None, k, "\n".join(lines)))
    got = {(r.conv_id, r.turn): r for r in quote_linking.chat_format(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for (c, t, _), (n, parents) in zip(rows, plain_link(rows), strict=True):
        r = got[c, t]
        assert r.n_linked == n and (r.parent_conv_id, r.parent_turn) in parents
    by: dict = {}
    for r in got.values():
        by.setdefault(r.thread_id, []).append(r)
    for thread in by.values():
        thread.sort(key=lambda r: (r.conv_id is not None, r.conv_id, r.turn))
        assert [r.position for r in thread] == list(range(len(thread)))


def test_announcing_lines():
    long = "On " + "x" * 300 + " wrote:"
    assert quote_linking.parse(f"{long}\n> a b\nreply")[0] == "reply"
    assert quote_linking.parse("Bob wrote:\ntext\nBob wrote:\n\n> a b\nreply")[0] == "Bob wrote:\ntext\n\nreply"
    assert quote_linking.parse("> a b\nas Bob wrote")[0] == "as Bob wrote"


@pytest.mark.parametrize("long", [100_000, 100])
def test_positions_of_long_threads(spark, monkeypatch, long):
    monkeypatch.setattr(quote_linking, "LONG", long)
    df = spark.range(2500).selectExpr("case when id < 2400 then 1L else null end as conv_id", "id as turn", "'user' as role", "concat('message number ', id) as text").repartition(4)
    got = {r.turn: r.position for r in quote_linking.chat_format(df).collect()}
    assert got == {k: k if k < 2400 else k - 2400 for k in range(2500)}
    text = "a very long message\n" * 50_000
    one = spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "> a very long message\nyes")], "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.n_linked, len(r.text)) for r in quote_linking.chat_format(one).orderBy("turn").collect()] == [(0, 0, len(text)), (1, 1, 3)]


def test_parse_levels():
    own, quotes = quote_linking.parse("> a b\n>> c d\n> > e f\ntext > not a quote")
    assert own == "text > not a quote" and quotes == [(1, "a b"), (2, "c d\ne f")]
