"""Page text and image copies."""

import numpy as np
import pytest

ARTICLE = "<html><head><title>T</title><script>var a='<p>x</p>';</script><style>p{}</style></head><body><nav><a href=#>Menu</a></nav><header>Top</header><aside>Side</aside><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; more</h1><p>One <b>bo</b>ld\n two.<p>Three&nbsp;four<br>five<form>Sign up</form><div class=ad>Buy</div></article><section id='comments'><p>Nice!</p></section><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    "source,text",
    [
        (ARTICLE, "Head & more One bold two. Three four five"), (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<main><p>in</p></main><p>out</p>", "in"), ("<div>x &lt;y&gt; &#65;&unknown;</div>", "x <y> A&unknown;"),
        ("<article>cut off <b>in the midd", "cut off in the midd"), ("<article>a<!-- c -->b</article>", "ab"), ("<article><ul><li>1<li>2</ul>t</article>", "1 2 t"), ("<a" * 50, ""), ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(source, text):
    from hopframe.llm.htmltext import main_text

    assert main_text(source or "", None) == text


def page(host, i, body):
    return f"https://{host}/p{i}", f"<html><body><div class='top'>Site</div><div class='links'><a>Home</a></div><div class='text'><h2>{body}</h2><p>{body} goes on for a while</p></div><div class='end'>bye {i}</div></body></html>"


def test_templates_find_the_main_slot(spark):
    from hopframe.llm.htmltext import deduce_templates, extract_pages, host_of

    rows = [(i, *page("h.org", i, f"story number {i} with words")) for i in range(12)] + [(50, "bad url", "<p>lone</p>"), (51, None, None), (52, "https://H.org/x", None), (0, *page("h.org", 0, "story number 0 with words"))]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, template string")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert extract_pages(pages).count() == len(rows)
    for i in range(12):
        assert got[i]["text"] == f"story number {i} with words story number {i} with words goes on for a while"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[50]["text"] == "lone" and got[51]["text"] == "" and got[52]["text"] == ""
    assert host_of("HTTP://u@Ex.org:80/x") == "ex.org" and host_of(None) == "" and host_of("x") == ""
    some = [r for r in rows if r[0] < 12][:12]
    trunk = deduce_templates(spark.createDataFrame(some, "no long, url string, html string")).collect()
    marks = [t["mark"] for t in trunk[0]["template"]]
    assert len(trunk) == 1 and "/html/body/div[class=text]" in marks and "/html/body/div[class=text]/p" in marks
    assert extract_pages(pages.limit(0)).count() == 0


def test_template_texts_go(spark):
    """Menus and notices in elements without telling names, inside the main container, on all or on some pages."""
    from hopframe.llm.htmltext import extract_pages

    def html(i):
        some = "<div class='q'>Open on Sundays too</div>" if i % 3 == 0 else ""
        body = f"{'All rights' if i % 4 else 'Some lefts'} of story {i} told at length here, with number {i * i}"
        return f"<html><body><div class='c'><div class='m|1'>Start Shop Contact</div>{some}<p>{body}</p></div></body></html>"

    rows = [(i, f"https://plain.org/{i}", html(i)) for i in range(30)] + [(40 + i, "https://same.org/x", "<div class='a'>only this</div>") for i in range(4)]
    rows += [(50, "https://plain.org/art", "<html><body><article><div class='m|1'>Start Shop Contact</div><p>kept</p></article></body></html>")]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == f"{'All rights' if i % 4 else 'Some lefts'} of story {i} told at length here, with number {i * i}"
    assert all(got[40 + i] == "only this" for i in range(4)) and got[50] == "Start Shop Contact kept"


def _told(i):
    return f"story {i * i} is told here with words of number {i} and more words after it"


LAYOUTS = {
    # containers of one path: only their places differ
    "plain.net": lambda i: f"<div>Start Shop</div><div><p>{_told(i)}</p></div><div>seen {i} times</div>",
    # more than two fifths of the free text are the template's
    "menu.net": lambda i: f"<div class='m1'>{'Start Shop Contact Imprint ' * 6}</div><div class='s1'><p>{_told(i)}</p></div><div class='d1'>seen {i} times</div>",
    "slash.net": lambda i: f"<div class='a/b'><p>{_told(i)}</p></div><div class='d/1'>seen {i} times</div>",
}


@pytest.mark.parametrize("tag", ["div", "section"])
def test_the_template_finds_the_slot_without_names(spark, tag):
    """Several hosts and layouts without article, main or telling class names."""
    from hopframe.llm.htmltext import extract_pages

    rows = [(100 * h + i, f"https://{host}/{i}", f"<html><body>{body(i).replace('div', tag)}</body></html>") for h, (host, body) in enumerate(LAYOUTS.items()) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: _told(i % 100) for i, *_ in rows}


def test_classes_are_ordered(spark):
    """Elements that one page of the host has in another order are no template; those around them and beside them are."""
    from hopframe.llm.htmltext import deduce_templates, extract_pages

    def html(i):
        a, b = f"<div class='x1'><p>{_told(i)}</p></div>", f"<div class='x2'>second part {i}</div>"
        return f"<html><body><div class='k1'>{a + b if i != 7 else b + a}</div><div class='k2'>seen {i}</div></body></html>"

    pages = spark.createDataFrame([(i, f"https://turn.net/{i}", html(i)) for i in range(12)], "no long, url string, html string")
    marks = [t["mark"] for t in deduce_templates(pages).first()["template"]]
    assert marks == ["/html", "/html/body", "/html/body/div[class=k1]", "/html/body/div[class=k2]"]
    got = {r["page_id"]: r["text"] for r in extract_pages(pages, "no").collect()}
    assert got == {i: f"{_told(i)} second part {i}" if i != 7 else f"second part {i} {_told(i)}" for i in range(12)}


def test_the_template_finds_what_the_article_holds(spark):
    """Pages of the tables without article, nav, footer and the class ad give the same text through the template."""
    from pyspark.sql import functions as F

    from hopframe.llm.htmltext import extract_pages

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plain = F.replace(F.regexp_replace("html", "(</?)(article|nav|footer)>", "$1div>"), F.lit('class="ad"'), F.lit('class="q"'))
    want = {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}
    assert {r["page_id"]: r["text"] for r in extract_pages(pages.withColumn("html", plain)).collect()} == want


def test_elements_with_unpaired_quotes_are_no_text():
    from hopframe.llm.htmltext import main_text

    assert main_text("<article><p>one <a href=\"x>two</a> three</p><p title=it's>four</p></article>", None) == "one two three four"
    assert main_text("<article><p>a < b and <b class='x>c</b></p></article>", None) == "a < b and c"


def test_copies_are_found(spark):
    from hopframe.llm.images import LEAST_POINTS, cropped_and_relit, describe, drawn_vectors, find_copies

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 64)).astype(np.float32)
    rows = [(i, i % 3 == 0, vectors[i % 55].tolist()) for i in range(60)] + [(60, False, None), (61, True, None), (62, True, [])]
    images = spark.createDataFrame([(*r, 1, "x", 7, 7, 7, 7, "y", *[3] * 7) for r in rows], "image_id long, is_query boolean, content array<float>, class_id int, picture string, hub long, least int, links int, wanted int, matches string, rows int, points int, a int, b int, side int, key int, x int")
    got = {r["image_id"]: r for r in find_copies(images, drawn_vectors("content"), cropped_and_relit).collect()}
    assert len(got) == 63
    assert all(got[i]["class_id"] == i % 55 for i in range(60)) and got[60]["class_id"] == 60 and got[61]["matches"] == []
    asked = [i for i in range(60) if got[i]["is_query"]]
    found = [got[i]["class_id"] in got[i]["matches"] for i in asked]
    assert np.mean(found) >= 0.9
    assert all(set(got[i]["matches"]) <= {got[i]["class_id"]} for i in asked)
    assert all(got[i]["matches"] is None and got[i]["links"] is None for i in range(60) if not got[i]["is_query"])
    assert got[61]["links"] == 0 and got[0]["links"] == 2 and got[6]["links"] == 1
    assert min(p for i in asked for p in got[i]["points"]) >= LEAST_POINTS
    flat = describe(np.full((2, 96, 96), 7, np.uint8))
    assert len(flat[0]) == 0 and find_copies(images.limit(0), drawn_vectors("content"), None).count() == 0


def _brute(render, vectors, edit):
    """(query, image) pairs that all descriptors of both decide."""
    import pyarrow as pa

    from hopframe.llm.images import LEAST_POINTS, agreement, describe

    rasters = render(pa.RecordBatch.from_pydict({"content": vectors.tolist()}))
    image, place, bits, _ = describe(np.stack(rasters))
    own = [(place[image == i], bits[image == i]) for i in range(len(vectors))]
    out = set()
    for q in range(len(vectors)):
        asked = describe(edit(rasters[q], q)[None])[1:3]
        out |= {(q, i) for i in range(len(vectors)) if agreement(asked, own[i]) >= LEAST_POINTS}
    return out


def test_near_equal_pictures_are_one_class(spark):
    """A large group of near-equal pictures: every query finds it by its representative, as brute force finds its members."""
    from hopframe.llm.images import cropped_and_relit, drawn_vectors, find_copies

    rng = np.random.default_rng(9)
    alone = rng.normal(size=(20, 64))
    base = rng.normal(size=64)
    near = base + rng.normal(size=(60, 64)) * 0.08
    vectors = np.concatenate([alone, near]).astype(np.float32)
    render = drawn_vectors("content")
    images = spark.createDataFrame([(i, i % 4 == 0, v.tolist()) for i, v in enumerate(vectors)], "image_id long, is_query boolean, content array<float>")
    got = {r["image_id"]: r for r in find_copies(images, render, cropped_and_relit).collect()}
    classes = {got[i]["class_id"] for i in range(20, 80)}
    assert len(classes) <= 12 and all(got[i]["class_id"] == i for i in range(20))
    brute = {(q, i) for q, i in _brute(render, vectors, cropped_and_relit) if q % 4 == 0}
    held = {(q, i) for q, i in brute if got[i]["class_id"] in got[q]["matches"]}
    assert len(brute) > 200 and len(held) >= 0.9 * len(brute)
    plain = {r["image_id"]: r for r in find_copies(images, render, cropped_and_relit, gather=False).collect()}
    found = {(q, i) for q in plain if plain[q]["is_query"] for i in plain[q]["matches"]}
    assert found <= brute and len(found) >= 0.95 * len(brute)


def test_an_id_with_two_contents(spark):
    from hopframe.llm.images import drawn_vectors, find_copies

    v = np.random.default_rng(3).normal(size=(3, 64)).astype(np.float32).tolist()
    rows = [(4, True, v[0]), (4, False, v[1]), (9, True, v[1]), (None, True, v[2]), (9, True, v[1])]
    got = find_copies(spark.createDataFrame(rows, "image_id long, is_query boolean, content array<float>"), drawn_vectors("content"), None).collect()
    # the classes of both contents of id 4 are named by it
    assert sorted(str((r["image_id"], r["class_id"], r["links"])) for r in got) == sorted(map(str, [(4, 4, 1), (4, 4, None), (9, 4, 3), (9, 4, 3), (None, None, 1)]))


def _noisy(raster, no):
    return np.clip(raster + np.random.default_rng(no).normal(0, 25, raster.shape), 0, 255).astype(np.uint8)


def _rescaled(raster, no):
    from hopframe.llm.images import _resized

    return _resized(raster[None].astype(np.float32), 0.85)[0].astype(np.uint8)


def _turned(raster, no):
    """By 20 degrees about the centre, nearest pixels."""
    h, w = raster.shape
    y, x = np.mgrid[0:h, 0:w] - np.array([h / 2, w / 2])[:, None, None]
    c, s = np.cos(np.pi / 9), np.sin(np.pi / 9)
    return raster[np.clip(np.rint(c * y - s * x + h / 2), 0, h - 1).astype(int), np.clip(np.rint(s * y + c * x + w / 2), 0, w - 1).astype(int)]


def _cropped(raster, no):
    from hopframe.llm.images import cropped_and_relit

    return cropped_and_relit(raster, no)


@pytest.mark.parametrize("edit", [_noisy, _rescaled, _turned, _cropped])
def test_copies_with_changed_descriptors_are_found(spark, edit):
    """Of the copies that brute force over all descriptors finds, at least nine tenths are found, and nothing else."""
    from hopframe.llm.images import drawn_vectors, find_copies

    vectors = np.random.default_rng(6).normal(size=(80, 64)).astype(np.float32)
    render = drawn_vectors("content")
    brute = _brute(render, vectors, edit)
    images = spark.createDataFrame([(i, True, v.tolist()) for i, v in enumerate(vectors)], "image_id long, is_query boolean, content array<float>")
    found = {(r["image_id"], c) for r in find_copies(images, render, edit).collect() for c in r["matches"]}
    print(edit.__name__, len(brute), len(brute & found))
    assert len(brute) >= 70 and found <= brute
    assert len(brute & found) >= 0.9 * len(brute)
