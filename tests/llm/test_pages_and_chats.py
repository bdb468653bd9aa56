"""Operators on pages and conversations, the pipeline, and the queries with SQL."""

import re
import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from chartline.llm import chat_format, html_text, language_id, line_dedup, url_filter
from chartline.llm.queries import ORACLE, QUERIES, piece_model
from check_queries import normal
from tests.llm.conftest import plain_words
from tests.llm.test_documents import joined, leaks

SF = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).resolve().parents[2])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


# --- chats

NASTY = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\|turn|> <|turn|>user\nhi<|end|>\n", "", None, "plain\n\ntext \\n", "🎉<s>é[\\INST]", "<|end|>\n<|turn|>assistant\n"]


def test_texts_come_back(spark):
    turns = [(1, k, role, t) for k, (role, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant", "a\\nb\n<|end|>", None))]
    turns += [(2, 0, "user", "x"), (2, 0, "user", "x"), (2, None, "assistant", "first"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.render(chat_format.fold(chat_format.plain_log(df)))
    back = {r.conv_id: r for r in made.withColumn("turns", chat_format.read_back(made.formatted)).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t in turns if _ is not None][: len(back[1].turns)]
    assert [tuple(t) for t in back[2].turns] == [("assistant", "first"), ("user", "x"), ("user", "x")]
    loss = [back[1].formatted[s.start : s.end] for s in back[1].loss_spans]
    assert [spark.range(1).select(chat_format.unescaped(chat_format.F.lit(x))).first()[0] for x in loss] == [t or "" for t in NASTY]
    assert chat_format.render(chat_format.fold(chat_format.plain_log(df.limit(0)))).count() == 0


def test_streamed_log_is_folded(spark):
    log = [
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 2, 1, "delta", "assistant", "lo"),
        (1, 3, 2, "message", "user", "More"), (1, 4, 0, "edit", "user", "Hi there"),
        (1, 5, 1, "regenerate", "assistant", ""), (1, 6, 1, "delta", "assistant", "Good "), (1, 7, 1, "delta", "assistant", "day"),
        (1, 8, 2, "message", "user", "Thanks"),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    made = chat_format.render(chat_format.fold(df))
    row = made.withColumn("turns", chat_format.read_back(made.formatted)).first()
    assert [tuple(t) for t in row.turns] == [("user", "Hi there"), ("assistant", "Good day"), ("user", "Thanks")]


# --- urls


def reference_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_hosts_paths_and_rules(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    urls += [None, "", "no scheme", "x://", "http://ORG", "http://Example.ORG/es/1?x", "a://b://c/d", "http://x.com/de/?q#f", "http://xcom/de/", "http://e.org?/x", "u\nv://a.org/\nb"]
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    out = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(out) == len(urls)
    for k, url in enumerate(urls):
        host, path, rule = reference_rule(url)
        assert (out[k].host, out[k].path, out[k].rule) == (host, path, rule[0] if rule else None)
        assert out[k].verdict == rule[1] if rule else out[k].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_templates_learn_from_labels(spark):
    pages = [("h.net", f"/shop/item{k}/buy", 1) for k in range(40)] + [("h.net", f"/blog/post-{k}", 0) for k in range(40)]
    pages += [("h.net", f"/tag/{c}{d}", None) for c in "abcdefgh" for d in "xyz"]
    df = spark.createDataFrame(pages, "host string, path string, bad int").withColumn("shapes", url_filter.shapes(url_filter.F.col("path")))
    found = {r.template: r.purity for r in url_filter.templates(df).collect()}
    assert found["/shop/item{n}/buy"] > 0.9 and found["/blog/post-{n}"] < 0.1
    assert any(t == "/tag/*" for t in found)


def test_deep_branches_are_told_apart(spark):
    deep = "/a" * 30
    pages = [("h.net", f"{deep}/bad/b{'/c' * 200}/{k}", 1) for k in range(40)] + [("h.net", f"{deep}/good/b/{k}", 0) for k in range(40)]
    pages += [("h.net", f"{deep}/good", 0), ("h.net", f"{deep}/bad/b{'/c' * 200}/x", None), ("h.net", f"{deep}/good/b/x", None), ("h.net", "/a", None)]
    df = spark.createDataFrame(pages, "host string, path string, bad int").withColumn("shapes", url_filter.shapes(url_filter.F.col("path")))
    found = {"/" + "/".join(r.shapes): (r.template, r.purity) for r in url_filter.templates(df).collect()}
    assert found[f"{deep}/bad/b{'/c' * 200}/x"][1] > 0.9 and found[f"{deep}/good/b/x"][1] < 0.1
    assert all(template == path for path, (template, _) in found.items())


def test_shared_segments_in_one_round_as_one_by_one(spark, monkeypatch):
    pages = [("h.net", f"/{k % 3}x/t/t/{'yz'[k % 2]}{'/u' * (k % 5 % 3)}", (None, 0, 1)[k * k % 11 % 3]) for k in range(90)]
    pages = [(h, p.replace("0x", "ax").replace("1x", "bx").replace("2x", "cx"), bad) for h, p, bad in pages]
    df = spark.createDataFrame(pages, "host string, path string, bad int").withColumn("shapes", url_filter.shapes(url_filter.F.col("path")))
    found = []
    for depth in (1, 100):
        monkeypatch.setattr(url_filter, "DEPTH", depth)
        found.append(sorted((r.shapes, r.template, round(r.purity, 9)) for r in url_filter.templates(df).collect()))
    assert found[0] == found[1]


# --- html


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Big &amp; small</h1><p><b>One<br>two<p>Three
    <span class="ad">buy</span>&nbsp;four<ul><li>x<li>y</ul><form><label>Name</label><input></form><aside>see also</aside>
    <section id="comments"><article><p>Nice!</p></article></section></article><div class="sidebar"><p>More</p></div><footer>&copy;</footer>"""
    assert html_text.main_text(page, set()) == "Big & small\nOne two\nThree four\nx\ny"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text < 3", "just text < 3"), ("<p title='a>b'>x<p title=\"oops>y", "x\ny"), ("<div hidden>x</div><div>z", "z"),
    ("<!-- <p>a</p> --><main><p>m</main><p>out", "m"), ("<script>x", ""), ("<p>a" + "</b>" * 50 + "b", "ab"),
])
def test_odd_pages(page, text):
    assert html_text.main_text(page, set()) == text


@pytest.mark.parametrize("attributes, shown", [
    ('title="the hidden cost of x"', True), ("title='say hidden here'", True), ('style="overflow: hidden !important"', True),
    ('title="display:none"', True), ('data-style="display:none"', True), ('title="aria-hidden=true"', True), ('alt="class=nav"', True),
    ('data-id="menu"', True), ('aria-hidden="false"', True), ('title="a hidden end', True), ('style="backface-visibility: hidden"', True),
    ("hidden", False), ('HIDDEN=""', False), ("hidden=until-found", False), ("aria-hidden=true", False), ("aria-hidden='TRUE'", False),
    ('style="color:red; display : none"', False), ("style=display:none", False), ('style="visibility:hidden!important;"', False),
    ('class="big nav"', False), ("id = menu", False),
])
def test_only_hidden_elements_are_hidden(attributes, shown):
    for tag in ("p", "span"):
        text = html_text.main_text(f"<article><h1>H</h1><{tag} {attributes}>x</{tag}></article>", set())
        assert text == ("H\nx" if shown else "H")


def test_site_template_is_removed(spark):
    def page(k):
        return f"<body><div id=top><p>All our shops</p></div><div class=body><p>Story {k}</p></div><div><p>Call us</p></div></body>"

    rows = [(k, "http://a.net/x", page(k)) for k in range(20)] + [(50, "http://b.net/", page(50)), (51, None, None), (52, "http://a.net/x", page(0))]
    out = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(out[k] == f"Story {k}" for k in range(20))
    assert out[50] == "All our shops\nStory 50\nCall us" and out[51] == "" and out[52] == "Story 0"


def test_copies_of_an_article_stay(spark):
    page = "<body><article><h1>H</h1><p>The same on every page</p></article></body>"
    df = spark.createDataFrame([(k, "http://a.net/x", page) for k in range(30)], "page_id bigint, url string, html string")
    assert {r.main_text for r in html_text.extract(df).collect()} == {"H\nThe same on every page"}


def test_copies_of_a_page_without_an_article_stay(spark):
    page = "<body><div><h1>H</h1><div><p>The same on every page</p></div></div></body>"
    other = "<body><div><p>Own text {}</p></div><div>Call us</div></body>"
    rows = [(k, page if k % 2 else other.format(k)) for k in range(40)]
    df = spark.createDataFrame([(k, "http://a.net/x", html) for k, html in rows], "page_id bigint, url string, html string")
    out = {r.page_id: r.main_text for r in html_text.extract(df).collect()}
    assert out == {k: "H\nThe same on every page" if k % 2 else f"Own text {k}" for k in range(40)}


def test_articles_with_inner_elements_stay(spark):
    page = (
        "<body><div><article><div><h1>H</h1><section><p>The same</p></section></div><ul><li>x<li><div>y</div></ul><table><tr><td>z</table>"
        "<div>By us</div></article></div><div>Visit {}</div></body>"
    )
    df = spark.createDataFrame([(k, "http://a.net/x", page.format(k)) for k in range(30)], "page_id bigint, url string, html string")
    assert {r.main_text for r in html_text.extract(df).collect()} == {"H\nThe same\nx\ny\nz"}


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for row in QUERIES["op6_html_extraction"](spark, SF).join(pages.select("page_id", "html"), "page_id").limit(50).collect():
        assert row.text and "track(" not in row.text and "&amp;" not in row.text and row.n_chars == len(row.text)


# --- pipeline


def test_pipeline(spark):
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0.7 * len(before) < len(out) <= len(before)
    assert len({r.doc_id for r in out}) == len(out)
    for r in out:
        assert r.decoded == r.text and r.n_chars == len(r.text) and r.n_tokens == len(r.ids)
    leaked = QUERIES["op4_benchmark_decontamination"](spark, SF).where("contaminated").select("doc_id").collect()
    assert not {r.doc_id for r in leaked} & {r.doc_id for r in out}
    joined = QUERIES["op7_ngram_jaccard_join"](spark, SF).collect()
    group = {r.doc_id: r.class_id for r in joined}
    assert len({group[r.doc_id] for r in out}) == len(out)


def site_with_near_copies():
    """120 pages of three hosts, each with its own header and two-line footer; 40 of them are near copies of one article."""
    body = [f"Sentence {k} of the article tells of {' '.join(f'thing{k}x{j}' for j in range(9))}" for k in range(35)]
    rows = []
    for k in range(120):
        lines = [*body] if k % 3 == 0 else [f"Page {k} line {j} says {' '.join(f'word{k}x{j}x{i}' for i in range(9))}" for j in range(35)]
        if k % 3 == 0:
            lines[k % 35] += f" edit{k}"
        host = f"h{k // 3 % 3}"
        rows.append((k, "\n".join([f"Welcome to {host}", *lines, f"Contact {host}", f"All rights with {host}"]), "en", host, 0))
    return body, rows


def test_near_copies_do_not_make_boilerplate(spark):
    body, rows = site_with_near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cut = corpus_pipeline.drop_site_lines(spark, docs, "").localCheckpoint()
    texts = {r.doc_id: r.text.split("\n") for r in cut.collect()}
    for key, text, _, host, _ in rows:  # only header and footer go, from all pages
        assert texts[key] == text.split("\n")[1:-2]
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, cut, "").collect()}
    assert left == {0} | {k for k in range(120) if k % 3}


def brute_force_pipeline(spark, folder):
    """(id, text, ids, decoded) of what the five stages keep, without the operators' joins and counts."""
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fitted = tuple(language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang")))
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if not language_id.classify(r["text"], fitted, language_id.MIN_MARGIN)[2]]
    group = {i: g for i, _, g, _, _ in joined(rows)}  # ids of the fixture are distinct
    on, pages = defaultdict(set), defaultdict(set)
    for r in rows:
        pages[r["source"]].add(group[r["doc_id"]])
        for line in set(r["text"].split("\n")) - {""}:
            on[r["source"], line].add(group[r["doc_id"]])
    gone = {k for k, groups in on.items() if len(groups) >= line_dedup.MIN_PAGES and len(groups) > line_dedup.RATIO * len(pages[k[0]])}
    for r in rows:
        was = r["text"]
        r["text"] = "\n".join(x for x in was.split("\n") if (r["source"], x) not in gone)
        r["lost"] = r["text"] != was and not r["text"].strip()
    rows = [r for r in rows if not r["lost"]]
    group = {i: g for i, _, g, _, _ in joined(rows)}
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    items = [(str(r.item_id), plain_words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r in rows if not leaks(r["text"], items)[1]]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    ids = [model.encode(r["text"], add_bos=True, add_eos=True) for r in rows]
    return [(r["doc_id"], r["text"], len(r["text"]), i, model.decode(i)) for r, i in zip(rows, ids, strict=True)]


def test_pipeline_as_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, more = site_with_near_copies()
    more = [(500_000 + k, *rest) for k, *rest in more]
    empty = "Welcome to h0\n\n\t\n\nContact h0\nAll rights with h0"
    more += [(600_000, None, "en", "h0", 0), (600_001, "", "en", "h0", 0), (600_002, empty, "en", "h0", 0), (600_003, "12 34", "en", "h1", 0)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = brute_force_pipeline(spark, str(tmp_path))
    got = [(r.doc_id, r.text, r.n_chars, list(r.ids), r.decoded) for r in out]
    assert sorted(got) == sorted(expected)
    assert {500_000} <= {r.doc_id for r in out} and not {600_000, 600_001, 600_002, 600_003} & {r.doc_id for r in out}


def test_empty_lines_are_no_text(spark):
    rows = [(k, f"Head\n{k} text {k}\nFoot", "en", "h", 0) for k in range(30)] + [(99, "Head\n\n\t\u00a0\nFoot", "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_site_lines(spark, docs, "").collect()}
    assert out == {k: f"{k} text {k}" for k in range(30)}


def test_entry_without_these_folders(tmp_path):
    """The driver file imports, and knows the other queries, when these folders are gone."""
    import shutil
    import subprocess
    import sys

    for name in ("__spark_entry__.py", "chartline"):
        source = Path(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any('op' == k[:2] for k in e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 51 and said[1] == "False" and said[0] == said[2]


def test_hash_of_the_extra_conversation(spark):
    row = QUERIES["op1_chat_formatting"](spark, SF).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# --- site templates


def counted_templates(pages):
    """host to template hashes, counted in Python over all pages."""
    on, names = {}, {}
    for url, page in pages:
        found = re.search(r"(?s)^.*?://([^/?#]*)", url or "")
        host = found[1].lower() if found else ""
        blocks, hashes = html_text.parse(page or "")
        name = tuple(b[0] for b in blocks if not b[3])
        names.setdefault(host, set()).add(name)
        for tree in set(hashes):
            on.setdefault((host, tree), set()).add(name)
    out = {}
    for (host, tree), seen in on.items():
        if len(seen) >= html_text.MIN_PAGES and len(seen) >= html_text.RATIO * (len(names[host]) + html_text.SMOOTH):
            out.setdefault(host, set()).add(tree)
    return out


def test_op6_as_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    template = counted_templates([(r.url, r.html) for r in rows])
    assert len(template) > 3
    got = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        host = r.url.split("://")[1].split("/")[0].lower()
        text = html_text.main_text(r.html, template.get(host, set()))
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, text, len(text))


@pytest.mark.parametrize("sent_trees", [-1, html_text.SENT_TREES])
def test_menus_go_by_the_template_alone(spark, sent_trees):
    """No known kind, word, article or main: 32 menus on 10 pages each of 320, and pages of another host."""
    def page(k):
        return f"<div class=q1><div>Shops {k % 32}</div><div>Maps {k % 32}</div></div><div class=q2><p>Story {k}</p><p>More of {k}</p></div>"

    rows = [(k, "http://a.net/x", page(k)) for k in range(320)] + [(1000 + k, "http://b.net/", page(k)) for k in range(5)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), sent_trees=sent_trees)
    out = {r.page_id: r.main_text for r in found.collect()}
    assert all(out[k] == f"Story {k}\nMore of {k}" for k in range(320))
    assert all(out[1000 + k].startswith(f"Shops {k}\nMaps {k}\nStory") for k in range(5))


def test_pages_in_odd_tables(spark):
    rows = [(1, "http://a.net/", "<p>x</p>", 7, "r")] * 30 + [(2, None, None, 7, "r"), (3, "no host", "", 7, "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, row string")
    for sent_trees in (-1, html_text.SENT_TREES):
        found = html_text.extract(pages, sent_trees=sent_trees)
        assert found.columns == ["page_id", "url", "host", "row", "main_text"]
        got = sorted(map(tuple, found.collect()), key=str)
        assert got == sorted([(1, "http://a.net/", 7, "r", "x")] * 30 + [(2, None, 7, "r", ""), (3, "no host", 7, "r", "")], key=str)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_dropped_elements_end_where_they_should():
    for page, text in (
        ("<nav><p>a<p>b</nav><p>c", "c"), ("<ul class=menu><li>a<li>b</ul><p>c", "c"), ("<form><select><option>a<option>b</select></form>c", "c"),
        ("<head><title>t</title><body><p>c", "c"), ("<footer><div>a</footer><p>c", "c"), ("<article><aside><p>a</aside><p>c</article>", "c"),
    ):
        assert html_text.main_text(page, set()) == text
