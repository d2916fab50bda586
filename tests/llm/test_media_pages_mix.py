"""Audio, HTML, mixing and URL rules against plain versions of each."""

import cmath
import hashlib
import io
import math
import random
import re
import statistics
import time
import wave
import zlib

import numpy as np
import pytest

from tidemark.llm import html_extract, media_audio, mixing, url_filter


def test_media_round_trip(nasty, nothing):
    rows = {(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()}
    got = media_audio.media(nasty, with_tensors=True).collect()
    assert len(got) == 11
    want = set()
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.add((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert {tuple(r)[:5] for r in got} == want
    for r in got:
        with wave.open(io.BytesIO(r.media)) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.getframerate()) == (1, 1, media_audio.RATE)
            assert hashlib.sha256(f.readframes(f.getnframes())).hexdigest() == r.payload_sha256
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        tensors = media_audio.from_ipc(r.tensors)
        assert tuple(tensors.schema.field("log_mel").type.shape) == (media_audio.PATCH, media_audio.MELS)
        assert all(a < b for a, b in zip(tensors["start_s"].to_pylist(), tensors["end_s"].to_pylist(), strict=True))
    assert len({r.feature for r in got if r.doc_id == 7}) == 1
    assert media_audio.media(nothing).count() == 0


def test_polyphase_is_upsampled_convolution():
    rng = np.random.default_rng(0)
    for up, down in ((2, 3), (5, 8), (1, 2), (3, 1)):
        x = rng.integers(-128, 128, 503).astype(np.int32)
        spread = np.zeros(len(x) * up, np.int64)
        spread[::up] = x
        full = np.convolve(spread, media_audio.low_pass(up, down).T.ravel().astype(np.int64))[8 * max(up, down) :][::down]
        y = media_audio.resample(x, up, down)
        assert len(y) == -(-len(x) * up // down)
        assert np.array_equal(y, full[: len(y)])


def test_blocks_do_not_show(monkeypatch):
    x = np.random.default_rng(1).integers(-128, 128, 5000).astype(np.int32)
    whole = media_audio.resample(x)
    monkeypatch.setattr(media_audio, "SAMPLE_BLOCK", 128)
    assert np.array_equal(whole, media_audio.resample(x))


def test_hysteresis_is_the_state_machine():
    rng = np.random.default_rng(2)
    for _ in range(50):
        e = rng.normal(size=80).astype(np.float32)
        level, on, state = np.median(e), False, []
        for v in e:
            on = True if v > level + 0.5 else False if v < level - 0.5 else on
            state.append(on)
        inside = np.zeros(80, bool)
        for a, b in media_audio.segments(e):
            inside[a:b] = True
        assert inside.tolist() == state


def test_mel_of_a_tone():
    t = np.arange(8000) / 8000
    mel, _ = media_audio.log_mel(np.sin(2 * np.pi * 1000 * t), 8000)
    centre = np.argmax(media_audio.mel_bands(8000)[1000 * 256 // 8000])
    assert abs(int(np.argmax(mel.mean(axis=0))) - int(centre)) <= 1


def plain_feature(samples, rate=12_000):
    """The digest of a payload step by step: sums written out, transforms by their definition."""
    x = [b - 128 for b in samples]
    taps = media_audio.low_pass(2, 3).T.ravel().tolist()
    spread = [v for s in x for v in (s, 0)]
    y = [sum(taps[k] * spread[i - k] for k in range(len(taps)) if 0 <= i - k < len(spread)) for i in range(24, 24 + len(spread) + 2, 3)][: -(-len(x) * 2 // 3)]
    y = [v / (128 * 2**15) for v in y]
    n = max(1, -(-max(0, len(y) - 200) // 80) + 1)
    y += [0.0] * ((n - 1) * 80 + 200 - len(y))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 199) for i in range(200)]
    bands = media_audio.mel_bands(8000).T.tolist()
    mel, energy = [], []
    for a in range(0, n * 80, 80):
        f = [v * w for v, w in zip(y[a : a + 200], window, strict=True)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / 256) for i, v in enumerate(f))) ** 2 for k in range(129)]
        mel.append([math.log(sum(p * b for p, b in zip(power, band, strict=True)) + 1e-6) for band in bands])
        energy.append(10 * math.log10(sum(v * v for v in f) / 200 + 1e-6))
    middle, on, patches, voiced, values, run = statistics.median(energy), False, 0, 0, [], []
    for i, e in enumerate([*energy, -1e9]):
        on = True if e > middle + 0.5 else False if e < middle - 0.5 else on
        if on:
            run.append(i)
            continue
        for a in range(0, len(run), 64):
            tile = [mel[j] for j in run[a : a + 64]]
            patches, voiced = patches + 1, voiced + len(tile)
            values += [v for row in tile for v in row] + [math.log(1e-6)] * (32 * (64 - len(tile)))
        run = []
    rounded = np.round(np.array(values, np.float32) * 100).astype("<i4")
    mean = rounded.mean() / 100 if len(rounded) else 0.0
    return f"frames={n};patches={patches};voiced_s={voiced * 0.01:.3f};mean={mean:.2f};crc={zlib.crc32(rounded.tobytes()):08x}"


def test_feature_by_its_definition():
    rng = random.Random(11)
    for size in (0, 40, 700, 2500):
        payload = media_audio.padded(bytes(rng.choice(b"abcdefgh  XYZ\n\xff\x00") if i // 500 % 2 else 120 for i in range(size)))
        assert media_audio.digest(media_audio.to_wav(payload)) == plain_feature(payload)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">Cookies?</div><div class="ad">Buy</div>
<article><header><h1>A &amp; B</h1></header><p>First <b>bold</b>word.<br>Second&nbsp;line &#233;&lt;i&gt;</p><aside>side</aside><p>Short</p>
<form><input value="x">Send</form><div class="share">Share</div><section id="comments"><article class="comment"><p>Nice</p></article></section></article>
<div class="sidebar">Other</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "A & B First boldword. Second line é<i> Short"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("plain words", "plain words"),
        ("<main>a<p>b<p>c</main><footer>d</footer>", "a b c"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>a</p></article><article><p>b</p></article>", "a b"),
        ("<ARTICLE><P CLASS='x>y'>a &am</ARTICLE>", "a &am"),
        ("<article><p><b>a<br><p>b</article>", "a b"),
        ("<article>a<script>b</article>", "a"),
        ("<div class='content has-sidebar'><article>a</article><div class='sidebar-left'>b</div></div>", "a"),
        ("<div id='promo'><article>a</article></div>", "a"),
        ("<div class='commentlist'>x</div><div class='cookieBanner'>y</div>", ""),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_surge_and_dive_without_an_article():
    long = "many words that make up a paragraph of the main text of this page, again and again. " * 3
    page = f"<div>Home</div><div>x</div><p></p><p></p><p></p><p>{long}</p><p>short</p><p>{long}</p><p></p><p></p><p></p><div>legal</div>"
    assert html_extract.main_text(page) == " ".join([long.strip(), "short", long.strip()])
    assert html_extract.window_sums([1, 2, 3, 4], 2) == [3, 5, 7, 4]


WORDS = "A paragraph of the main text of a page that nobody put into an article element, with a good many words, number"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><p>{WORDS} 1</p></div><div><p>{WORDS} 2, longer</p></div>", f"{WORDS} 1 {WORDS} 2, longer"),
        (f"<table><tr><td>{WORDS} 1</td></tr><tr><td></td><td></td><td></td><td>{WORDS} 2</td></tr></table>", f"{WORDS} 1 {WORDS} 2"),
        (f"<p>{WORDS} 1</p><div class=ad><p>x</p><p>y</p><p>z</p></div><p>{WORDS} 2, longer</p><aside><p>x</p><p>y</p><p>z</p></aside><p>The end.</p>", f"{WORDS} 1 {WORDS} 2, longer The end."),
        (f"<p>{WORDS} 1</p><p></p><p></p><p></p><p>{WORDS} 2, longer</p>", f"{WORDS} 1 {WORDS} 2, longer"),
        (f"<div><p>{WORDS} 1</p><p>{WORDS} 2</p></div><article>Read this too</article>", f"{WORDS} 1 {WORDS} 2 Read this too"),
        (f"<p>Site</p><nav><p>a</p><p>b</p></nav><p>{WORDS} 1</p><nav>a</nav><footer>b</footer><aside>c</aside><p>Imprint</p>", f"{WORDS} 1"),
        (f"<div><p>Site</p></div><article><p>Short</p><p>{WORDS} 1</p></article><div><p>Imprint</p></div>", f"Short {WORDS} 1"),
    ],
)
def test_all_text_between_the_first_surge_and_the_last_dive(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><header class='entry-header'><h1>Title</h1></header><p>a</p></article>", "Title a"),
        ("<article><p>a</p><section id='related-work'><p>b</p></section><section id='sharing-data'>c</section><h2 id='navigation'>d</h2><section id='cookies'>e</section></article>", "a b c d e"),
        ("<a href='#x'>Skip</a><div class='layout sidebar-right'><article>The text of it</article></div>", "The text of it"),
        ("<p>x</p><form id='aspnet'><div class='page-wrapper'><main><p>The text of it</p></main></div></form>", "The text of it"),
        (f"<p>Site</p><form><p>{WORDS} 1</p><p>{WORDS} 2</p><form class='search'>find</form></form>", f"Site {WORDS} 1 {WORDS} 2"),
        (f"<div id='sidebar-layout'><div class='widget'>{WORDS} 1</div></div><p>x</p>", f"{WORDS} 1 x"),
        (f"<article>Teaser</article><div class='layout-sidebar'>{WORDS * 10}</div>", f"Teaser {WORDS * 10}"),
        (f"<div class='ad'>{WORDS}</div><article>Short post</article>", "Short post"),
        (f"<article>Short post</article><section class='comments-area'><article class='comment'>{WORDS} 1</article></section>", "Short post"),
        (f"<article>Short post<section id='comments'>{WORDS} 1</section><div class='share-buttons'>Share</div></article><div class='site-footer'>x</div><div id='main-nav'>y</div>", "Short post"),
    ],
)
def test_names_hide_no_article_text(page, text):
    assert html_extract.main_text(page) == text


def test_extracted_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    got = html_extract.extracted(df).collect()
    assert len(got) == 3 and {(r.page_id, r.n_chars) for r in got} == {(1, len("A & B First boldword. Second line é<i> Short")), (None, 0)}


def plain_targets(sizes, weights, total, epochs):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    left = total
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= epochs * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= set(over)
    return target


def test_mixture_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 400])), rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(600)] + [(600, None, "e"), (601, None, None), (None, "x y", "a"), (602, "x", "z"), (602, "x", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes, mixing.WEIGHTS, 1.5 * sum(sizes.values()), 2)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(v, 6) for v in want.values()})
    assert sum(r.taken for r in got) == pytest.approx(sum(want.values()), abs=len(want))
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(df.repartition(7)).collect()), key=str)
    clash = df.selectExpr("*", "1 AS _mix_cut", "2 AS doc", "3 AS col", "4 AS _mix_whole")
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).count() == mixing.mixed(df).count()
    again = mixing.mixed(df)
    assert again.columns == df.columns
    taken = {}
    for r in again.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    for s, v in want.items():
        assert abs(taken.get(s, 0) - v) <= 201


def test_many_sources_are_joined_in_parts(spark, nasty, monkeypatch):
    few = sorted(map(tuple, mixing.mixture(nasty).collect()), key=str)
    rows = sorted(map(tuple, mixing.mixed(nasty).collect()), key=str)
    monkeypatch.setattr(mixing, "bounded", lambda df: None)
    assert sorted(map(tuple, mixing.mixture(nasty).collect()), key=str) == few
    assert sorted(map(tuple, mixing.mixed(nasty).collect()), key=str) == rows


def test_mixture_of_nasty_rows(nasty, nothing):
    got = mixing.mixture(nasty).collect()
    assert len(got) == 11 and {r.size for r in got if r.doc_id in (1, 2)} == {0}
    assert mixing.mixture(nothing).count() == mixing.mixed(nothing).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "/en/x", "allow"), ("net", "/es/", "block"), ("b.net", "", "block"), ("com", "/en/long/path/", "block")]
URLS = ["http://example.com/en/a", "https://WWW.Example.com/en/x?q#f", "http://a.b.example.com/en/x/y", "http://xexample.com/en/", "http://com/", "http://com", "http://b.net", "http://a.net/es/", "http://anet/es/", "no scheme", None, "", "http://", "ftp://com?x/", "http://e-x.com/en/long/path/z", "http://www.example.com/en/long/path/", "http://www.example.com#/en/", "http://net/es/1\n2", "http://a..net/es/", "http://com./x", "http://x\x01com/en/", "http://com\x02/\x03/", "http://" + "a." * 3000 + "net/es/" + "y" * 9000]


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("bound", [1, 4, 40])
def test_verdicts(spark, bound):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS * 20)], "page_id long, url string, host string").repartition(5)
    want = sorted((i, *plain_verdict(u)) for i, u in enumerate(URLS * 20))
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("COM", "/", "allow")], "host string, path string, verdict string")
    for given in (RULES, rules):
        got = url_filter.verdicts(df, given, ranges=bound).collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert url_filter.verdicts(df.limit(0), RULES, ranges=bound).count() == 0
    assert {r.verdict for r in url_filter.verdicts(df, []).collect()} == {"allow"}


def test_rules_against_all_pairs(spark):
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "", ".org", "a.org"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/pq", "/é/"]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(30)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{rng.choice(['', 'w.', 'a.', 'b.a.', '.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q', '/'])}" for _ in range(400)]
    urls += ["http://a.com/p/hot"] * 400
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)

    def plain(url):
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fit, default=(0, 0, None, "allow"))[2:])

    for ranges in (1, 7, 50):
        assert sorted(map(tuple, url_filter.verdicts(df, rules, ranges=ranges).collect())) == [(i, *plain(u)) for i, u in enumerate(urls)]


def test_page_tables(spark):
    """Names that clash and empty tables."""
    df = spark.createDataFrame([(1, "http://net/es/", "<p>x</p>", "t", 3, "r")], "page_id long, url string, html string, text string, n_chars int, rule string")
    assert [tuple(r) for r in html_extract.extracted(df).collect()] == [(1, "http://net/es/", "x", 1)]
    assert html_extract.extracted(df.limit(0)).count() == url_filter.verdicts(df.limit(0), []).count() == 0
    assert [r.verdict for r in url_filter.verdicts(df, RULES).collect()] == ["block"]


def test_unmatched_tags_take_linear_time():
    began = time.time()
    for page in ("<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000):
        assert html_extract.main_text(page + "text") == "text"
    assert time.time() - began < 10


def test_line_blocks_against_a_plain_search():
    """Surge and dive by trying every window, on pages of paragraphs and menus without an article."""
    rng = random.Random(4)
    for _ in range(300):
        parts = [("nav", "menu item") if rng.random() < 0.3 else ("p", rng.choice(["", "x", "short text", WORDS, WORDS + " more"])) for _ in range(rng.randint(1, 14))]
        page = "".join(f"<{k}>{t}</{k}>" for k, t in parts)
        lines = ["" if k == "nav" else t for k, t in parts]
        size = [len(t) for t in lines]
        sums = [sum(size[i : i + 3]) for i in range(len(size))]
        least = min(86, max(*sums, 1, 1))
        # surges: where text starts a heavy window, and none is open; a stretch dives where three empty lines follow
        kept, i = [], 0
        while i < len(lines):
            if not size[i] or sums[i] < least:
                i += 1
                continue
            j = next((j for j in range(i + 1, len(lines)) if not any(size[j : j + 3]) and j + 3 <= len(lines)), None)
            end = j if j is not None else max(k for k in range(len(lines)) if size[k]) + 1
            kept.append((i, end))
            i = (j + 3) if j is not None else len(lines)
        want = " ".join(t for t in lines[kept[0][0] : kept[-1][1]] if t) if kept else ""
        assert html_extract.main_text(page) == want, page


def test_any_markup_is_survived():
    rng = random.Random(9)
    parts = ["<", ">", "</", "<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<script>", "</script>", "<!--", "-->", "&amp", "&#x110000;", "&#0;", '"', "'", "=", "text", " ", "\n", "<b", "hidden", "<br/>", "<x-y z=1>", "é", "<!", "]]>", "<a href='"]
    for _ in range(3000):
        text = html_extract.main_text("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
        assert text == " ".join(text.split())
