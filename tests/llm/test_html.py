from tidepool.llm.html import extract, main_text, path_scores, text_nodes

ARTICLE = "<p>First paragraph, which is long enough, and has marks. It goes on; it does.</p><p>Short.</p><p>Another long paragraph, which talks about things, and more; and so on.</p>"
WANT = "First paragraph, which is long enough, and has marks. It goes on; it does.\nShort.\nAnother long paragraph, which talks about things, and more; and so on."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title>{head}</head><body>{body}</body></html>"


def test_boilerplate_of_all_kinds_goes():
    around = '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, please accept. Really, do accept them all.</p></div>{}<aside><p>Related: many, many things.</p></aside><form><p>Your name, please.</p><input></form><section id="comments"><p>I like this article, very much, indeed. It is good.</p></section><footer><p>&copy; x, y, z.</p></footer>'
    style, script = "<style>p{margin:0}</style>", '<script>var t="</p><p>no, no, no</p>";</script>'
    for inner in (f"<article><h1>Title</h1>{ARTICLE}</article>", f'<div class="post-content"><h1>Title</h1>{script}{ARTICLE}<div class="ad">Buy, now.</div><!-- no, no --></div>', f'<main class="has-sidebar"><header><h1>Title</h1></header>{ARTICLE}<noscript>no</noscript></main>'):
        assert main_text(page(around.format(inner), style + script)) == "Title\n" + WANT


def test_without_signals_paths_decide():
    assert main_text(page(f"<div><a href=1>Home</a> <a href=2>News</a></div><div>{ARTICLE}</div><div><a>Imprint</a></div>")) == WANT


def test_references_white_space_and_broken_markup():
    assert main_text("<article><p>a&nbsp;&amp; b&#233;\n\t c &lt;x&gt; <b>bo</b>ld</p><p>x<br>y") == "a & bé c <x> bold\nx y"
    assert main_text("<p><b>One two, three.<br><p>Four five, six.</p>") == "One two, three.\nFour five, six."
    assert main_text("plain text, no tags at all.") == "plain text, no tags at all."
    assert main_text("") == "" and main_text("<") == "<" and main_text("<p") == "<p" and main_text("<script>x") == ""
    assert main_text("<div>" * 3000 + "deep, deep text." + "</div>" * 2999) == "deep, deep text."


def test_scores_are_per_path():
    scores = path_scores(text_nodes(page(f"<div>{ARTICLE}</div><div class=x>a</div>")))
    assert scores["/html/body/div/p"] == 1.0 and scores["/html/body/div.x"] < 0.1


def test_table_of_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, f"<article>{ARTICLE}</article>", "x"), (1, "u", "", "x"), (2, "v", page("<article>" + ARTICLE * 2000 + "</article>"), "x"), (2, "v", page("<article>é, é.</article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect()}
    assert (1, "u", "", 0) in got and (None, None, WANT, len(WANT)) in got and (2, "v", "é, é.", 5) in got and (2, "v", "\n".join([WANT] * 2000), 2000 * (len(WANT) + 1) - 1) in got
    assert extract(df.limit(0)).count() == 0


def test_weak_names_only_weigh():
    other = "<p>An unnamed block, which is as long as the others, and has marks. It goes on, too.</p>" * 2
    for cls in ("text-center", "story-card", "main-col"):  # one such block does not drop the rest of the page
        got = main_text(page(f'<div class="{cls}"><p>Sign up, now.</p></div><div>{ARTICLE}</div>'))
        assert WANT in got
        assert main_text(page(f'<div class="{cls}">{ARTICLE}</div><div>{other}</div>')).startswith(WANT + "\nAn unnamed block")
    assert WANT in main_text(page(f"<article>{ARTICLE}</article><div>{other}</div>")) and "unnamed" in main_text(page(f"<article>{ARTICLE}</article><div>{other}</div>"))
    for around in ('<div class="social">{}</div>', '<form id="search">{}</form>'):  # names that speak against do not drop a whole page
        assert main_text(page("<nav><a>Home</a></nav>" + around.format(ARTICLE))) == WANT


def test_ratios_decide_inside_an_article_too():
    menu = "<div><i>Ab</i></div>" * 40
    long = ARTICLE.replace("things", "things, of which there are a great many, and of which more is said") * 20
    got = main_text(page(f"<article><h1>Title</h1>{long}<ul><li>Point one</li><li>Point two</li></ul><section>{menu}</section></article>"))
    assert got.startswith("Title\nFirst paragraph") and got.endswith("Point one\nPoint two")


def test_frame_without_article():
    assert main_text(page("<nav><a>Home</a></nav><footer><p>Some address, with marks. And more.</p></footer>")) == ""
    assert main_text(page(f'<p style="display:none">{WANT}</p><div hidden>{WANT}</div>')) == ""


def test_attributes_are_read_one_by_one():
    """Names count, not what stands in other attributes' values."""
    menu = "<div><a href=1>Home</a> <a href=2>News</a></div>"
    assert main_text(page(f'{menu}<article data-title="The hidden valley">{ARTICLE}</article>')) == WANT
    assert main_text("<article><p data-id='ad-7'>One, two. Three, four.</p><p>a <b title='hidden gem'>bold, word</b></p></article>") == "One, two. Three, four.\na bold, word"
    assert main_text(f"<p class=it's>{WANT}</p>") == WANT.replace("\n", " ")
    assert main_text(f"<article title=\"a > b\" data-x='c > \"d\"' >{ARTICLE}</article >") == WANT
    assert main_text('<p title="never closed>Text, one. Two.</p>') == "Text, one. Two."
    assert main_text(f"<div aria-hidden=true>{ARTICLE}</div><p>Seen, this one. Yes.</p><p STYLE='Display : None'>no</p>") == "Seen, this one. Yes."
    assert main_text(f"<div data-hidden id=x class>{ARTICLE}</div>") == WANT


def test_readers_comments_go():
    said = "".join(f"<p>Reader {i} says, at some length, what was wrong; and more, of course. Really.</p>" for i in range(40))
    for named in ("class='comments'", 'id="comments"', "class='post-comments'", "id=disqus_thread"):
        assert main_text(page(f"<div>{ARTICLE}</div><div {named}>{said}</div>")) == WANT
    assert main_text(page(f"<div class='comments-open'>{ARTICLE}</div><div class=x><p>Imprint</p></div>")).startswith(WANT)
    assert main_text(page(f"<div class='comments'>{ARTICLE}</div>")) == WANT  # all there is


def test_time_is_linear():
    import time

    for piece in ("<a '", "<a b=\"", "<a b='x>", "<", "</", "<!--", "<p title=x", "<script", "&", "<div><a", "<div>", "<b><p>", "<div></p>", "<li></ul>"):
        start = time.time()
        main_text(piece * 40_000)
        assert time.time() - start < 4, piece


def naive_scores(blocks):
    """Ratios by the description, from (path, block, text, weight) of blocks of one text each."""
    import math

    by = {}
    for path, block, text, weight in blocks:
        by.setdefault(path, []).append((block, text, weight))
    count = lambda ps: (sum(len(t) for p in ps for _, t, _ in by[p]), sum(sum(c in ".,;:!?" for c in t) for p in ps for _, t, _ in by[p]), sum(len({b for b, _, _ in by[p]}) for p in ps))
    fused = {}
    for path, rows in by.items():
        chars, marks, n = count([path])
        all_chars, all_marks, all_n = count([p for p in by if p.rsplit("/", 1)[0] == path.rsplit("/", 1)[0]])
        ratio, mark_ratio = (chars / n + all_chars / all_n) / 2, ((marks + 1) / n + (all_marks + 1) / all_n) / 2
        fused[path] = (ratio * mark_ratio) ** 0.5 * math.log(1 + all_chars) * rows[0][2]
    best = max(fused.values())
    return {p: v / best for p, v in fused.items()}


def test_scores_against_the_description():
    import random

    rng = random.Random(6)
    for _ in range(50):
        body, blocks, n = "", [], 0
        for cls in ("x", "y", "ad", "z"):
            inner = ""
            for _ in range(rng.randint(1, 4)):
                tag, text = rng.choice(["p", "h2", "li"]), " ".join(rng.choice(["word", "so,", "end.", "why?", "é"]) for _ in range(rng.randint(1, 30)))
                inner += f"<{tag}>{text}</{tag}>"
                blocks.append((f"/html/body/div.{cls}{'!' if cls == 'ad' else ''}/{tag}", n, text, 1 / 16 if cls == "ad" else 1.0))
                n += 1
            body += f"<div class={cls}>{inner}</div>"
        got, want = path_scores(text_nodes(page(body))), naive_scores(blocks)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
