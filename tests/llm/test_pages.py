import base64
import hashlib
import html
import random
import re
from collections import Counter

import pytest

from gleaner.llm import extraction, warc

PAGE = """<!DOCTYPE html><html><head><title>T words here</title><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><div class="cookie-notice">We use cookies ok</div>
<main><article><header><h2>Title   here</h2></header><p>First para &amp; some <b>bold</b>er words.<p>Unclosed second para &eacute;&#233;
<aside>Related stuff to read</aside><form><label>Your email here</label></form><ul><li>one item</li><li>two items</li></ul>
<p>Last para.</p><section id="comments"><p>Nice post I like it a lot</p></section></article></main>
<div id="sidebar">links links</div><footer>&copy; me</footer>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_main_text_without_surroundings(spark):
    rows = [(i, "u", f"<nav><a>Menu {i}</a></nav><article><h1>Head {i}</h1><p>Some text number {i} of this page.</p></article><footer>foot</footer>", "x") for i in range(30)]
    rows += [(90, "u", PAGE, "x"), (91, None, None, "x"), (92, "v", "", None), (92, "v", "", None), (93, "w", "<article>" + "<p>word</p>" * 5000 + "</article>", None), (None, "n", "<p", None)]
    table = pages(spark, rows)
    found = {}
    for r in extraction.extract(table, extraction.fit(table)).collect():
        found.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert found[3][0].text == "Head 3\nSome text number 3 of this page."
    assert found[90][0].text == "Title here\nFirst para & some bolder words.\nUnclosed second para éé\none item\ntwo items\nLast para."
    assert found[91][0].text == found[92][0].text == "" and len(found[92]) == 2
    assert found[93][0].text == "\n".join(["word"] * 5000)
    assert extraction.extract(table.limit(0), extraction.fit(table.limit(0))).count() == 0


def test_best_region_is_the_greatest_sum():
    import random

    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        a, b = extraction.best_region(x)
        assert sum(x[a:b]) == max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def learned(pages_of):
    """Weights learned from pages, without Spark."""
    inside, outside = Counter(), Counter()
    for page in pages_of:
        for x in extraction.items(page):
            side = inside if x.inside else outside
            side[x.key] += 1 if x.text is None else x.words
            if x.words:
                side.update(dict.fromkeys((f".{t}" for t in extraction.tokens_above(x.place)), x.words))
    return extraction.learn(inside, outside, len(pages_of))


def test_the_learned_region_decides(sf_dir, monkeypatch):
    import pandas as pd

    real = [x for x in pd.read_parquet(f"{sf_dir}/pages.parquet")["html"].dropna() if extraction.labelled(extraction.items(x))]
    weights = learned(real)
    with_priors = [extraction.main_text(x, weights) for x in real]
    for page, text in zip(real, with_priors):
        # By brute force: the words between the tags of the element that the author marked.
        marked = re.sub(r"<[^>]*>", " ", page[page.index("<article>") : page.index("</article>")])
        assert text.split() == html.unescape(marked).split()
    monkeypatch.setattr(extraction, "PRIORS", {})
    monkeypatch.setattr(extraction, "TAG_PRIORS", {})
    bare = learned(real)
    assert [extraction.main_text(x, bare) for x in real] == with_priors
    monkeypatch.setattr(extraction, "best_region", lambda scores: (0, len(scores)))
    assert all(extraction.main_text(x, weights) != y for x, y in zip(real, with_priors))


def test_scores_of_random_pages_against_all_regions():
    rng = random.Random(4)
    for _ in range(60):
        body = "".join(rng.choice(["<p>a b c</p>", "<div class=ad>x y</div>", "<ul><li><a>m</a></li></ul>", "<nav><a>n o</a></nav>", "<h2>t u</h2>"]) for _ in range(rng.randrange(8)))
        scores, skips = extraction.Weights().scores(extraction.items(body))
        a, b = extraction.best_region(scores)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[a:b]) == pytest.approx(best) and len(skips) == len(scores)


def test_embedded_boilerplate_and_telling_names():
    words = lambda n, w="word": " ".join([w] * n)
    text = lambda page: Counter(extraction.main_text(page, extraction.Weights()).split())
    aside = f"<p>{words(12, 'one')}</p><aside>{words(300, 'side')}</aside><p>{words(40, 'two')}</p>"
    assert text(f"<nav><a>Menu</a></nav><article>{aside}</article><footer>f</footer>") == {"one": 12, "two": 40}
    assert text(f"<div class=nav><a>M</a></div><div id=content>{aside}</div>") == {"one": 12, "two": 40}
    assert text("<article><p>We saw <a href=x>the long matter</a></p><p><a>Read it all</a></p><p>end</p></article>") == Counter("We saw the long matter Read it all end".split())
    for name in ("post-share-text", "story ad-free", "widget-content", "widget"):
        assert text(f"<nav><a>Menu here</a></nav><h1>Title</h1><div class='{name}'><p>{words(50)}</p></div>") == {"Title": 1, "word": 50}, name
    assert text(f"<div class=post><p>{words(20)}</p></div><div class='comment-content'><p>{words(400, 'c')}</p></div>") == {"word": 20}
    assert text("<nav><a>Menu a b c</a></nav><footer>foot note text</footer>") == {}


WHOLE = "<h1>Head line</h1><p>First words of it.</p><p>Last words of it.</p>"


@pytest.mark.parametrize(
    "page, expected",
    [
        # Names of the elements around the one marked article say nothing, nor does a form around it.
        (f"<nav>Menu</nav><div id=search-engines-article><article>{WHOLE}</article></div><footer>f</footer>", WHOLE),
        (f"<nav>Menu</nav><div class='comments nav'><main>{WHOLE}<aside>Side words</aside></main></div>", WHOLE),
        (f"<body><form action=/><nav>Menu here</nav><article>{WHOLE}</article><label>Your email</label></form></body>", WHOLE),
        # Without a marked element: what is left is read by tags, and within a form around the page without its labels.
        (f"<nav>Menu</nav><div id=search-engines>{WHOLE}</div><footer>f</footer>", WHOLE),
        (f"<body><form><nav>Menu here</nav><div>{WHOLE}</div><label>Your email</label><button>Go</button></form></body>", WHOLE),
        # What is hidden stays so, a teaser in a sidebar is none, and a notice alone is no main text.
        (f"<div hidden><article>{WHOLE}</article></div><footer>f</footer>", ""),
        (f"<aside class=related><article>One teaser</article></aside><div class=post>{WHOLE}</div>", WHOLE),
        ("<nav>Menu</nav><div class=cookie-notice>We use cookies here</div><footer>f</footer>", ""),
        ("<form><label>Your name</label><input><label>Your email</label><input><button>Send</button></form>", ""),
        # Tables, lists, nested divisions and text without any block.
        (f"<table><tr><td class=menu>Menu</td><td>{WHOLE}</td></tr></table>", WHOLE),
        ("Plain words<br>of a page", "<p>Plain words of a page</p>"),
        (f"<div class=wrapper><div class=inner><div class=sidebar><ul><li><a>x</a></li></ul></div>{WHOLE}</div></div>", WHOLE),
    ],
)
def test_pages_of_other_layouts(page, expected):
    blocks = [re.sub("<[^>]*>", "", x) for x in re.split(r"</(?:h1|p)>", expected) if x]
    assert extraction.main_text(page, extraction.Weights()).split("\n") == (blocks or [""])


def test_words_in_the_marked_element_are_counted_once():
    found = extraction.items(f"<div><section><article><div>{WHOLE}</div><p>a b</p></article></section><p>out</p></div>")
    around, words = extraction.around_marked(found)
    assert (len(around), words) == (2, 12)
    assert extraction.around_marked(extraction.items("<article>a</article><article>b</article>")) == (frozenset(), 0)


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "same", None), (2, "http://b/", "same", None), (9, "http://c/ü\n", "ünï\r\n\r\nWARC/1.1\r\n", None), (1, None, None, None), (4, "e", "", None), (7, "l", "x" * 300000, None), (7, "l", "x" * 300000, None), (None, "n", "same", None)]
    folder = str(tmp_path / "warc")
    files = warc.write_warc(pages(spark, rows), folder)
    found = warc.read_warc(files, folder).collect()
    assert {r.kind for r in found} == {"record"} and len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.page_id, []).append(r)
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert (by[2][0].record_type, by[5][0].record_type, by[5][0].refers_to) == ("response", "revisit", 2)
    assert (by[1][0].record_type, by[4][0].refers_to, by[4][0].record_type) == ("response", 1, "revisit")
    assert [r.record_type for r in by[7]] == ["response", "response"] and bytes(by[9][0].payload).decode() == rows[2][2]
    assert warc.write_warc(pages(spark, []), folder).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_records_after_damage(packed):
    raw = [warc.record("response", i, f"http://x/{i}", f"<p>{i}</p>".encode() * 60, None) for i in range(8)]
    parts = [warc.gzipped(x) for x in raw] if packed else raw
    at = [sum(map(len, parts[:i])) for i in range(9)]
    data = bytearray(b"".join(parts))
    data[at[2] + len(parts[2]) // 2] ^= 0x55
    data = bytes(data[: at[5] + 20] + data[at[6] :]) + parts[0][: len(parts[0]) // 2]
    found = list(warc.salvage(data))
    assert [f.headers["x-page-id"] for f in found if not f.reason] == ["0", "1", "3", "4", "6", "7"]
    gaps = [(f.at, f.size) for f in found if f.reason]
    assert gaps == [(at[2], len(parts[2])), (at[5], 20), (len(data) - len(parts[0]) // 2, len(parts[0]) // 2)]
    assert sum(f.size for f in found) == len(data)
