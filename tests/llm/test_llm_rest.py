"""Chats, pages, vectors, the registered queries and the pipeline."""

import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from conftest import SMALL
from riskboard.llm import ann, bpe, chat, decontaminate, html, queries
from test_llm_texts import plain_kept, plain_removed

TURNS = "conv_id bigint, turn bigint, role string, text string"


# --- chats


def test_chat_reads_back(spark):
    data = [(1, 0, "user", "a"), (1, 2, "assistant", "</s>[INST] & &lt; <s>"), (1, 1, "user", None), (1, 3, "assistant", "b[TURN]"),
            (1, 4, None, ""), (2, 0, "assistant", "é\U0001f600"), (None, None, "user", "x"), (None, None, "user", "x"),
            (3, 0, "[ROLE]<", "r"), (3, 0, "[ROLE]<", "q")]
    rows = spark.createDataFrame(data, TURNS).withColumn("turns", F.lit(1)).withColumn("mask", F.lit("clash"))
    made = chat.formatted(rows)
    told = {r["conv_id"]: r for r in made.collect()}
    assert told[1]["formatted"] == ("<s>[ROLE]user[/ROLE]a[TURN]</s><s>[ROLE]assistant[/ROLE]&lt;/s>&#91;INST] &amp; &amp;lt; &lt;s>"
                                    "[TURN]b&#91;TURN]</s><s>[ROLE][/ROLE]</s>")
    for r in told.values():
        assert sum(m["length"] for m in r["mask"]) == len(r["formatted"])
    at, learnt = 0, []
    for m in told[1]["mask"]:
        if m["loss"]:
            learnt.append(told[1]["formatted"][at:at + m["length"]])
        at += m["length"]
    assert learnt == ["&lt;/s>&#91;INST] &amp; &amp;lt; &lt;s>", "b&#91;TURN]"]
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(made).collect()}
    assert back[1] == [("user", "a", False), ("user", "", False), ("assistant", "</s>[INST] & &lt; <s>", True),
                       ("assistant", "b[TURN]", True), ("", "", False)]
    assert back[None] == [("user", "x", False)] * 2 and back[3] == [("[ROLE]<", "q", False), ("[ROLE]<", "r", False)]
    assert chat.digests(rows.limit(0)).count() == 0


def test_chat_equals_its_sql(spark):
    ok, note = compare(spark, connect(SMALL), "op4_chat", queries.QUERIES["op4_chat"], queries.SQL["op4_chat"], SMALL)
    assert ok, note


def test_chat_runs_no_python(spark):
    plan = queries.QUERIES["op4_chat"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- pages

PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body>
<header class="site"><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div id="cookie-notice">We use cookies</div><div class="layout sidebar-right"><aside>Links</aside>
{body}
<section class="comments"><article class="comment"><p>{comment} a very long reader comment {comment}</p></article></section></div>
<form><p>Search</p></form><script>var x = "<p>no</p>";</script><footer>&copy; Site</footer></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    return {r["page_id"]: r["text"] for r in html.main_text(df).collect()}


def test_article_without_its_surroundings(spark):
    body = ("<article><header><h1>Head &amp; line</h1></header><p>One\n two&nbsp;<b>three<p>four<br>five"
            "<ul><li>a<li>b</ul><div class=ad>Buy</div><p class=notice>Note</p><pre>x  y</pre>&#169; &lt;tag&gt; 1 < 2</article>")
    got = texts(spark, [(k, f"http://h{k % 2}.example.com/{k}", PAGE.format(body=body.replace("four", f"four{k}"), comment=k))
                        for k in range(6)])
    assert got == {k: f"Head & line\nOne two three\nfour{k} five\na\nb\nx y\n© <tag> 1 < 2" for k in range(6)}


def test_wrapper_finds_content_without_an_article(spark):
    """Plain divisions: what is the same on most pages is template, the rest is content."""
    page = ("<body><div><p>Company of record</p><p>Call us now</p></div><div class=story><p>{0} first {0}</p><p>{0} second part</p></div>"
            "<div><p>All rights reserved</p></div></body>")
    got = texts(spark, [(k, "https://plain.example.org/x", page.format(f"text{k}")) for k in range(8)])
    assert got == {k: f"text{k} first text{k}\ntext{k} second part" for k in range(8)}


def test_odd_pages(spark):
    pages = [(1, None, None), (2, "x", ""), (3, "http://a.b/", "no markup at all"), (4, "http://a.b/", "<p>open"), (5, "http://a.b/", "<"),
             (6, "http://a.b/", "<article>" + "<p>w</p>" * 5000 + "</article>"), (7, "http://a.b/", "<!-- never closed"),
             (8, "http://a.b/", "<script>never closed"), (9, "http://a.b/", "<div>" * 3000 + "deep")]
    got = texts(spark, pages)
    assert got[1] == got[2] == got[7] == got[8] == "" and got[3] == "no markup at all" and got[4] == "open" and got[5] == "<"
    assert got[6] == "\n".join(["w"] * 5000) and got[9] == "deep"
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.main_text(none).count() == 0


def test_deep_pages_of_one_host(spark):
    """Two different pages nested deeper than Python's stack, each of the other's host."""
    deep = lambda n, text: "<div>" * n + f"<p>{text}</p><b>x</b>"
    got = texts(spark, [(1, "http://a.b/", deep(1500, "one") + "<i>y</i>"), (2, "http://a.b/", deep(1500, "two")),
                        (3, "http://a.b/", "<font>" * 900 + "three<b>z</b>")])
    assert got == {1: "one\nxy", 2: "two\nx", 3: "threez"}


def test_headings_and_forms_are_not_surroundings(spark):
    """Ids made from headings inside an article, and a form around the whole page."""
    body = ("<h2 id=related-work>Related work</h2><p>A{0}</p><section id=social-policy class=policy-comment><p>B{0}</p></section>"
            "<div id=comment-on-the-ruling>C{0}</div><div class='box related'>More</div><form>Find<input></form>")
    story = "<div class=story><p>{0} first {0}</p><p>{0} second part</p></div>"
    pages = [(k, "http://a.b/", f"<body><form id=aspnet><article>{body.format(k)}</article></form></body>") for k in range(3)]
    pages += [(k, "http://c.d/", f"<body><form><p>Menu</p>{story.format(f'text{k}')}</form></body>") for k in range(3, 9)]
    got = texts(spark, pages)
    assert got == {**{k: f"Related work\nA{k}\nB{k}\nC{k}" for k in range(3)},
                   **{k: f"text{k} first text{k}\ntext{k} second part" for k in range(3, 9)}}


def test_wrapper_does_not_hang_on_one_page(spark):
    """The smallest page of the host is null or an error page, and the host has two layouts."""
    one = "<body><div><p>Company of record</p></div><div class=story><p>{0} first {0}</p><p>{0} second part</p></div></body>"
    two = "<body><section><ul><li>Call us now</ul></section><section class=body><p>{0} other {0}</p><p>{0} end of it</p></section></body>"
    pages = [(None, "http://a.b/0", None), (0, "http://a.b/0", ""), (1, "http://a.b/1", "<h1>404</h1>Not found")]
    pages += [(k, f"http://a.b/{k}", (one if k % 3 else two).format(f"text{k}")) for k in range(2, 20)]
    got = texts(spark, pages)
    assert got == {None: "", 0: "", 1: "404\nNot found", **{
        k: f"text{k} first text{k}\ntext{k} second part" if k % 3 else f"text{k} other text{k}\ntext{k} end of it"
        for k in range(2, 20)}}


def test_constant_notice_inside_articles(spark):
    """A notice without a telling class, inside each article or in plain divisions: template.
    The same words elsewhere in an article, and pages that hold nothing else, stay."""
    notice = "<p>Sign up <b>for free</b> today</p>"
    article = "<body><article><h1>Head {0}</h1>{1}{2}{1}</article></body>"
    more = lambda k: "".join(f"<p>text{k} part{j}</p>" for j in range(1 + k % 4))
    pages = [(k, "http://a.b/", article.format(k, notice, more(k))) for k in range(8)]
    pages += [(8, "http://a.b/", "<body><article>" + notice + "</article></body>"),
              (9, "http://a.b/", "<body><article><h2>Sign up</h2><p>text9</p></article></body>")]
    pages += [(k, "http://c.d/", f"<body><div><p>Follow us</p></div><div class=s><p>{k} a {k}</p><p>{k} b</p></div></body>")
              for k in range(10, 16)]
    got = texts(spark, pages)
    assert got == {**{k: "\n".join([f"Head {k}", *(f"text{k} part{j}" for j in range(1 + k % 4))]) for k in range(8)},
                   8: "Sign up for free today", 9: "Sign up\ntext9", **{k: f"{k} a {k}\n{k} b" for k in range(10, 16)}}


def test_deep_and_unclosed_pages_are_linear(spark):
    begin = time.perf_counter()
    for page in ("<div>" * 100_000 + "x", "<div>t" * 30_000, "<font>t" * 100_000, "<div class=menu>" * 30_000 + "t", "<p>" * 100_000,
                 "<li>t" * 50_000, "<form>t" * 20_000, "<font>" * 50_000 + "</b>" * 50_000):
        root = html.parse(page)
        html.blocks(root)
        html.frame(root)
        bones = html.skeleton(root)
        assert html._unpack(html._pack(bones))[0] == list(bones[0])
    assert time.perf_counter() - begin < 60
    deep = "<div>" * 70_000
    assert texts(spark, [(1, "http://a.b/", deep + "one"), (2, "http://a.b/", deep + "<i>two</i>"), (3, "http://a.b/", "<p>three")]) == {
        1: "one", 2: "two", 3: "three"}


def test_classes_of_any_form(spark):
    """Line breaks and numbers in classes: the same place on all pages of a host."""
    page = ("<body><div class='top\n bar'><p>Company of record</p></div><div class='post-{0}\n\tstory page-{0}'>"
            "<p>{0} first {0}</p><p>{0} second part</p></div></body>")
    pages = [(k, "http://a.b/", page.format(k)) for k in range(12)]
    assert texts(spark, pages) == {k: f"{k} first {k}\n{k} second part" for k in range(12)}
    for attr in ("class='a\nb'", "class='b a'", "class='\x1fa \x85b'", "class=''", "class='\n'", "id='x\ny'", 'class="a/b#c.d"'):
        bones = html.skeleton(html.parse(f"<div {attr}>t<b {attr}>u</b></div>"))
        depth, label, words, size = html._unpack(html._pack(bones))
        assert (depth, label, words.tolist(), size.tolist()) == tuple(map(list, bones))
    one, two = (html.parse(f"<div class='{c}'>").kids[0].label for c in ("a\nb-12", "b-7  a"))
    assert one == two


def test_all_text_of_an_article_stays(spark):
    body = ("<p>Area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> units</p><menu><li>one</li><li>two</li></menu><label>Note</label> here"
            "<svg><text>no</text></svg><form><label>no</label></form>")
    got = texts(spark, [(1, "http://a.b/", f"<body><menu><li>Home</li></menu><article>{body}</article></body>")])
    assert got == {1: "Area is x=2 units\none\ntwo\nNote here"}


def plain_match(a, b):
    """Size of the largest simple tree matching, by the textbook recursion."""
    def size(x, y):
        if a.label[x] != b.label[y]:
            return 0
        kx, ky = a.kids[x], b.kids[y]
        m = [[0] * (len(ky) + 1) for _ in range(len(kx) + 1)]
        for i in range(1, len(kx) + 1):
            for j in range(1, len(ky) + 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + size(kx[i - 1], ky[j - 1]))
        return m[-1][-1] + 1
    return size(0, 0)


def test_tree_matching_is_largest():
    rng = np.random.default_rng(4)

    def tree(shapes):
        depth, label = [0], ["r"]
        for _ in range(int(rng.integers(1, 14))):
            depth.append(int(rng.integers(1, depth[-1] + 2)))
            label.append("ab"[rng.integers(0, 2)])
        return html.Tree(depth, label, shapes)
    for _ in range(200):
        shapes = {}
        a, b = tree(shapes), tree(shapes)
        pairs = html.match(a, b)
        assert len(pairs) == plain_match(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert all(a.label[x] == b.label[y] for x, y in pairs)


def test_skeletons_pack():
    bones = html.skeleton(html.parse(PAGE.format(body="<p class='k é'>x</p>", comment="c")))
    depth, label, words, size = html._unpack(html._pack(bones))
    assert (depth, label, words.tolist(), size.tolist()) == tuple(map(list, bones))


# --- nearest neighbours


def test_neighbours_of_random_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    vectors[1000:2000] = vectors[0]  # a third of all rows is one vector
    data = [(k, v.tolist()) for k, v in enumerate(vectors)]
    data += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [None] + [1.0] * 23),
             (5080, [float("inf")] * 24), (None, vectors[3].tolist())]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    hit = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        score = (vectors * vectors[q]).sum(axis=1)
        assert all(s == score[v] for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        score[q] = -np.inf
        true = np.lexsort((np.arange(3000), -score))[:20]
        hit += len(set(true) & {g[1] for g in got})
    assert hit >= 0.9 * 20 * len(found)
    assert [v for _, v, _ in found[0]] == list(range(1000, 1020))  # ties go to the smaller id


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])],
                               "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(df).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 20, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.0), (0, 4, 1, -1.0)]
    assert [g for g in got if g[0] == 20] == [(20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 1, -1.0)]
    assert ann.search(df.limit(0)).count() == 0


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    parts = rng.integers(0, 1 << 16, (800, ann.PARTS))
    asked = parts[:50] ^ (1 << rng.integers(0, 16, (50, ann.PARTS)))
    for radius in (0, 3, 9, 25, 64):
        want = np.bitwise_count(asked[:, None, :] ^ parts[None, :, :]).sum(axis=2) <= radius
        index = ann.Index(parts, 16)
        assert all(np.array_equal(index.within(own, radius), np.flatnonzero(w)) for own, w in zip(asked, want))


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(1)
    data = [(k, rng.standard_normal(5).tolist()) for k in range(100)] + [(200, [1.0] * 4), (220, [1.0] * 6)]
    got = ann.search(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 60, 80} and max(r["vec_id"] for r in got) < 100


# --- queries and pipeline

COLUMNS = {
    "op1_quality": "doc_id held_out score predicted", "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op5_html": "page_id url text n_chars",
    "op6_simhash": "doc_id fingerprint component_id", "op7_ann": "query_id rank vec_id score",
    "op8_suffix": "doc_id n_bytes n_removed n_spans kept_sha256", "op9_binary": "doc_id start n_tokens ids_crc32",
    "op10_langid": "doc_id held_out lang_pred score"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_covers_its_table(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    assert got.columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
    table = {"op4_chat": "conversations", "op5_html": "pages", "op7_ann": "embeddings"}.get(name, "documents")
    key = {"op4_chat": "conv_id", "op5_html": "page_id", "op7_ann": "vec_id"}.get(name, "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()}
    if name == "op7_ann":
        assert {r["query_id"] for r in got.collect()} == {v for v in want if v % 20 == 0}
    else:
        assert {r[0] for r in got.select(key).collect()} == want | ({-1} if name == "op4_chat" else set())


def test_pages_of_the_table(spark):
    import html as entities
    import re
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.QUERIES["op5_html"](spark, SMALL).collect():
        page = raw[r["page_id"]]
        inner = page[page.index("<article>"):page.index("</article>")]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", p))).strip()
                 for p in re.split(r"</?(?:p|h1|article)[^>]*>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_entry_registers_everything():
    import __spark_entry__ as entry
    named = entry.queries()
    assert {n.split("_")[0] for n in named if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert named["pipeline"] is corpus_pipeline.run and "op4_chat" in entry.oracle_sql()


def test_pipeline_equals_brute_force(spark, rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if any(map(str.isalpha, r["text"]))]
    kept = set(plain_kept(left))
    left = [x for x in left if x[0] in kept]
    gone = plain_removed([t for _, t in left], 200)
    matcher = decontaminate.Matcher([(r["item_id"], r["text"]) for r in bench])
    told = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=dict(bpe.read_ranks(corpus_pipeline.RANKS)))
    stages = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        stages = stage(spark, stages, SMALL)
        assert stages.columns == docs.columns
    cleaned = {r["doc_id"]: r["text"] for r in stages.collect()}
    assert set(cleaned) == {d for d, _ in left}
    for (d, text), (n_bytes, n_removed, _, digest) in zip(left, gone):
        lost = len(text.encode()) - n_removed - len(cleaned[d].encode())
        assert 0 <= lost <= 6  # halves of cut characters
        if n_removed == 0:
            assert cleaned[d] == text
    want = {d: told.encode_ordinary(t) for d, t in cleaned.items() if not matcher.leaks(t)}
    assert {d: list(r["ids"]) for d, r in got.items()} == want


def test_stages_take_odd_and_empty_tables(spark):
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra map<string,int>"
    rows = [(1, "the cat sat on the mat and went home", "en", "s", 1, {"a": 1}), (2, None, None, None, None, None),
            (3, "", "en", "s", 0, {}), (None, "der Hund ging nach Hause", "de", None, 2, None),
            (1, "the cat sat on the mat and went home", "en", "s", 1, {"a": 1})]
    inner = ("_lang _share _langs _node _key key digest n print rare row c first root id g i j side set spans _k gram spot "
             "grams places singles a b left right total item_id edits ids decoded c0 c5").split()
    for df in (spark.createDataFrame(rows, ddl).withColumns({c: F.lit(c) for c in inner}), spark.createDataFrame([], ddl)):
        n = df.count()
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() <= n


# --- components


def test_components_of_links(spark, rows):
    import random

    from riskboard.llm.graph import components
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)]
    links += [(1000 + k, 1001 + k) for k in range(90)] + [(2000, 2001 + k) for k in range(200)] + [(5, 5), (-7, 3), (3, -7)]
    group = {n: {n} for link in links for n in link}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    want = sorted((n, min(g)) for n, g in group.items() if len(g) > 1)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert rows(got) == sorted(want, key=repr)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
