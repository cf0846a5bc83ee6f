"""The ten operators against brute force, and their edge cases: nulls, empty and very long texts, ties, repeated rows, empty tables, further columns."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stakewell.llm import chat, decontaminate, html, minhash, mixing, neighbours, quality, tokens, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOC + ", id string, key string, size long, h long, words string, __id long, label int"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
PROSE = [f"the {a} river runs past {b} old mills and {c} quiet farms before it meets the sea near {a} harbour towns" for a, b, c in (("wide", "nine", "ten"), ("long", "six", "two"), ("calm", "five", "four"))]
ODD_TEXTS = [None, "", " \n\t", "one", "two words", LONG, LONG, "\x1c\x1f <|endoftext|> <|ENDOFTEXT|> ΣΑΣ é é", "日本語 テキスト", *PROSE, PROSE[0], "'s 'T don't 12345 ½ ²³ _x_", "tail"]


def odd_docs(spark):
    rows = [(None if i == 3 else i // 2 if i > 8 else i, t, None, None if i % 4 == 0 else f"s{i % 3}", None, "x", "y", 1, 2, "z", 5, 0) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, EXTRA)


def docs_of(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- 1


def token_truth(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    out, start = [], 0
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_tokens_round_trip(spark):
    rows = sorted((r.doc_id, r.text) for r in docs_of(spark).select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_output(docs_of(spark)).collect())
    assert got == token_truth(rows)


def test_tokens_odd_rows(spark):
    got = [tuple(r) for r in tokens.token_output(odd_docs(spark)).collect()]
    text = {(n, c) for _, _, n, c in token_truth([(0, t) for t in ODD_TEXTS])}
    assert len(got) == len(ODD_TEXTS) and {(n, c) for _, _, n, c in got} == text
    got.sort(key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(i for i in ids if i is not None) + [None]  # null last
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:]))
    assert tokens.token_output(spark.createDataFrame([], DOC)).collect() == []


def test_token_files_random_access(spark):
    files = tokens.write_tokens(docs_of(spark), tokens.vocabulary("word_bpe_49k.json"), sequence=64, batch=4)
    part = files[0]
    n = -(-part[2] // 64)
    whole, mask = tokens.sequences(part[1], 0, n)
    assert whole.shape == (n, 64) and mask.sum() == part[2]
    for i in (0, 3, 4, n - 1):
        one, m = tokens.sequences(part[1], i, i + 1)
        assert (one[0] == whole[i]).all() and (m[0] == mask[i]).all()


# ---- 2


PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/x>Menu {i}</a></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>Title {i}</h1><p>First &amp; best <b>word</b>{i}<br>next<p>Second &#8220;par&nbsp;agraph&#8221; {i}</p><div class='share-buttons'>Share this</div></article><aside>Side {i}</aside><form><input>Search</form><div id=comments><p>A reader said {i}</p></div><script>var a='<p>no</p>';</script><footer>(c) {i}</footer></body></html>"


def test_html_article_only(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i)) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Title {i} First & best word{i} next Second “par agraph” {i}"


def test_html_tables_and_odd_rows(spark):
    got = {r.page_id: r.text for r in html.extract(docs_of(spark, "pages")).collect()}
    import html as entities

    for r in docs_of(spark, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert got[r.page_id] == " ".join(entities.unescape(inner).split())
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    odd = [(1, None, None, "a"), (2, "", "", "b"), (3, "no url", "plain words <b>only", "c"), (4, "http://u:p@H.example:8/x", "<p>" + LONG, "d"), (4, "http://h.example/x", "<p>" + LONG, "d"), (None, "http://h.example/", deep, "e")]
    rows = {(r.page_id, r.url): r for r in html.extract(spark.createDataFrame(odd, "page_id long, url string, html string, host string")).collect()}
    assert rows[1, None].text == "" and rows[2, ""].n_chars == 0 and rows[3, "no url"].text == "plain words only"
    assert rows[4, "http://h.example/x"].text == LONG and rows[None, "http://h.example/"].text == "deep text"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def extracted(spark, pages):
    frame = spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(frame).collect()}


def test_html_constant_parts_are_template(spark):
    """Names that mean nothing: what is the same on all pages goes, also single items of a list and the last paragraph."""
    say = lambda i, k: " ".join(f"word{i}x{k}x{j}" for j in range(12))
    page = "<body><div class=qzx><ul><li>Home page<li>All about us</ul></div><div class=vvv><p>{a}</p><p>{b}</p><p>Subscribe now to our paper</p></div><div class=kkw>Made with care in town</div></body>"
    got = extracted(spark, [page.format(a=say(i, 1), b=say(i, 2)) for i in range(30)])
    assert got == {i: f"{say(i, 1)} {say(i, 2)}" for i in range(30)}
    # One page alone, or copies of one page, tell nothing about what is constant.
    alone = extracted(spark, [page.format(a=say(0, 1), b=say(0, 2))] * 5)
    assert all(say(0, 1) in t and say(0, 2) in t for t in alone.values())


def test_html_copies_of_an_article_stay(spark):
    page = "<body><div class=ad>{i} buy</div><article><h1>One title</h1><p>One text of many words that all of the pages share, copied over and over.</p></article></body>"
    assert set(extracted(spark, [page.format(i=i) for i in range(12)]).values()) == {"One title One text of many words that all of the pages share, copied over and over."}


def test_html_names_yield_to_most_of_the_text(spark):
    """A form round the whole page and a container called notice board hold the article; comments never do."""
    say = lambda i, k, n=30: " ".join(f"word{i}x{k}x{j}" for j in range(n))
    forms = [f"<body><form id=aspnetForm><div><h1>{say(i, 0, 3)}</h1><article><p>{say(i, 1)}</p></article></div><div class=menu>{say(i, 2, 5)}</div></form></body>" for i in range(5)]
    assert extracted(spark, forms) == {i: say(i, 1) for i in range(5)}
    boards = [f"<body><div class=top>{say(i, 0, 4)}</div><div class='notice-board'><p>{say(i, 1)}</p><p>{say(i, 2)}</p></div></body>" for i in range(5)]
    assert all(f"{say(i, 1)} {say(i, 2)}" in t for i, t in extracted(spark, boards).items())
    talk = [f"<body><article><p>{say(i, 0, 8)}</p></article><div class=comments><p>{say(i, 1, 90)}</p></div></body>" for i in range(5)]
    assert extracted(spark, talk) == {i: say(i, 0, 8) for i in range(5)}


def test_html_alignment():
    tree = lambda source: html.Wrapper(p.tree, p.figures(html._hash(source))) if (p := html.Page(source)) else None
    one, two = tree("<div class=a><p>x</p></div><div class=b><p>y</p></div>"), tree("<div class=a><p>x</p></div><section><p>new</p></section><div class=b><p>z</p></div>")
    found = one.align(two)
    assert {two.label[b]: one.label[a] for b, a in found.items()} == {"#root": "#root", "div.a": "div.a", "div.b": "div.b", "p": "p"} and len(found) == 5
    one.merge(two)
    assert [one.label[c] for c in one.children[0]] == ["div.a", "section", "div.b"]
    same = {one.label[i]: one.figures[one.children[i][0]][1] for i in one.children[0]}
    assert same["div.a"] is not None and same["div.b"] is None


def test_html_tags_that_never_end_and_quotes():
    import time

    text = lambda s: html.Extractor().text("", None, s)
    assert text("<article><p data-x=it's>Hello there</p><p>World's end</p></article>") == "Hello there World's end"
    assert text('<article><p title="a > b">one</p><p>2 < 3 and 4 > 1</p></article>') == "one 2 < 3 and 4 > 1"
    began = time.time()
    for piece in ("<a x ", "<div>", '<p x="', "<p x='", "<b>", "<!-", "<ul><li>", "</p>"):
        text("before " + piece * (1_000_000 // len(piece)))
    assert time.time() - began < 120


# ---- 3


def test_chat_collapse(spark):
    say = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(t)]
    rows = [*say(1, "a"), *say(2, "a", "b"), *say(3, "a", "b", "c"), *say(4, "a", "x"), *say(5, "a", "b", "c"), *say(6, None, ""), *say(7, "b", "a"), (None, 0, "user", "a"), (8, None, None, "q"), (8, 0, "user", "p"), (8, 0, "user", "p")]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, k string, n int")
    got = {r.conv_id: r for r in chat.chat_format(frame).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[3].copies == 2 and got[3].n_turns == 3
    assert got[8].text == "<|im_start|>user\np<|im_end|>\n<|im_start|>\nq<|im_end|>\n"
    assert chat.chat_format(frame.limit(0)).collect() == []


def test_chat_many_turns(spark):
    rows = [(c, i, "user", f"t{i}") for c, n in ((1, 1500), (2, 1400), (3, 1501)) for i in range(n)]
    got = sorted((r.conv_id, r.part, r.n_turns) for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == [(3, 0, 1501), (3, 1, 1501)]


# ---- 4


def shingle_counts(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    return w, (Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([" ".join(w)] if w else []))


def similarity(a, b):
    m = sum((a & b).values())
    return m / max(1, sum(a.values()) + sum(b.values()) - m)


def test_leaks_like_brute_force(spark):
    docs, bench = docs_of(spark), docs_of(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    want = set()
    items = [(r.item_id, *shingle_counts(r.text)) for r in bench.collect()]
    for r in docs.collect():
        w, grams = shingle_counts(r.text)
        for item, iw, ig in items:
            if grams.keys() & ig.keys() and any(similarity(shingle_counts(" ".join(w[k : k + len(iw)]))[1], ig) >= 0.8 for k in range(max(1, len(w) - len(iw) + 1))):
                want.add((r.doc_id, item))
    assert got == want and want


def test_leaks_edits_and_odd_rows(spark):
    item = " ".join(f"alpha{i} beta{i}" for i in range(25))
    edited = item.replace("alpha12", "changed").upper().replace(" ", ",  ")
    broken = " ".join(w if i % 5 else "gap" for i, w in enumerate(item.split()))
    docs = [(1, f"x {edited} y"), (2, broken), (3, LONG + " " + item), (4, "too short"), (5, None), (6, ""), (6, item), (6, item), (None, item)]
    frame = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, words string, start int")
    bench = spark.createDataFrame([(10, item, 1), (11, item, 2), (12, "Too short!", 3), (13, None, 4), (14, "...", 5)], "item_id long, text string, w int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench).collect()}
    assert got == {(d, i) for d in (1, 3, 6, None) for i in (10, 11)} | {(4, 12)}
    left = decontaminate.decontaminated(frame, bench)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {2, 5}
    assert decontaminate.matches(frame.limit(0), bench).count() == 0 and decontaminate.matches(frame, bench.limit(0)).count() == 0


def test_leaks_with_moved_halves(spark):
    """A passage whose halves changed places is found, in all windows that brute force finds."""
    item = [f"word{i}{'x' * (i * 7 % 11)}" for i in range(60)]
    texts = [item[30:] + item[:30], ["before"] * 9 + item[30:] + item[:30] + ["behind"] * 9, item[40:] + item[20:40] + item[:20], item[20:] + ["between"] + item[:20]]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.start) for r in decontaminate.matches(frame, bench).collect() if r.n_words == 60}
    grams = shingle_counts(" ".join(item))[1]
    want = {(i, k) for i, w in enumerate(texts) for k in range(len(w) - 59) if similarity(shingle_counts(" ".join(w[k : k + 60]))[1], grams) >= 0.8}
    assert got == want and {0, 1} <= {i for i, _ in want}


# ---- 5


def exact_neighbours(ids, x, q, k):
    score = np.einsum("ij,j->i", x, x[q])
    other = np.flatnonzero(ids != ids[q])
    return other[np.lexsort((ids[other], -score[other]))[:k]]


def test_neighbours_recall(spark):
    rows = docs_of(spark, "embeddings")
    got = neighbours.nearest(rows, F.col("id") % 20 == 0).toPandas()
    data = rows.orderBy("vec_id").toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want = exact_neighbours(ids, x, q, 20)
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(mine) + 1)) and mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, x[[int(np.flatnonzero(ids == v)[0]) for v in mine.vec_id]] @ x[q], rtol=0, atol=1e-12)
        hit, total = hit + len(set(ids[want]) & set(mine.vec_id)), total + len(want)
    assert hit / total >= 0.95


def test_neighbours_blocks_and_odd_rows(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 16)).round(1)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(700)] + [(700, None, 1), (720, [0.0] * 16, 1), (740, [float("nan")] * 16, 1), (760, [float("inf")] + [0.0] * 15, 1), (780, [None] + [1.0] * 15, 1), (800, [1.0], 1), (40, [float(v) for v in x[40]], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = neighbours.nearest(frame.drop("id"), F.col("id") % 20 == 0, k=5, block=100).toPandas()
    assert set(got.query_id) == set(range(0, 700, 20))
    hit = 0
    for q in set(got.query_id) - {40}:
        hit += len(set(exact_neighbours(np.arange(700), x, q, 5)) & set(got[got.query_id == q].vec_id))
    assert hit >= 0.9 * 5 * 34
    few = neighbours.nearest(frame.filter("vec_id IN (0, 1, 2)"), F.col("id") % 20 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert neighbours.nearest(frame.limit(0), F.col("id") % 20 == 0).collect() == []


def test_multi_index_finds_the_whole_radius():
    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    flips = r.random((200, 128)) < np.linspace(0, 0.3, 200)[:, None]
    codes[:200] = codes[0] ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64).reshape(200, 2)
    index, probed = neighbours.Index(codes), 0
    true = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 3, 7, 8, 12, 20, 30, 39, 64, 128):
        rows, dist = index.within(codes[0], radius)
        assert set(rows) == set(np.flatnonzero(true <= radius)) and (dist == true[rows]).all()
        probed += index.probed(codes[0], radius) is not None
    assert probed >= 5


@pytest.mark.parametrize("kind", ["clustered", "uneven", "offset"])
def test_neighbours_recall_on_other_vectors(spark, kind):
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 24))
    x = centres[r.integers(0, 60, 4000)] + 0.3 * r.normal(size=(4000, 24))
    x = x * r.lognormal(0, 0.5, (4000, 1)) if kind == "uneven" else x + 4 if kind == "offset" else x
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("id") % 40 == 0, k=10, block=500).toPandas()
    hit = sum(len(set(exact_neighbours(np.arange(4000), x, q, 10)) & set(got[got.query_id == q].vec_id)) for q in range(0, 4000, 40))
    assert hit >= 0.9 * 10 * 100 and (got.groupby("query_id").size() == 10).all()


# ---- 6


def test_warc_round_trip_and_audit(spark):
    odd = [(1, None, None, "a"), (2, "http://x/\r\n", "", "b"), (3, "http://x", LONG, "c"), (3, "http://x", LONG, "c"), (None, "http://y", "<p>", "d")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string, file string")
    records = warc.write_warc(pages)
    got = warc.audit(records, warc.copy_files(records, F.col("page_id") == 3)).collect()
    assert sorted((str(r.page_id), r.n_bytes, r.status) for r in got) == sorted([("1", 0, "intact"), ("2", 0, "intact"), ("3", len(LONG), "differs"), ("3", len(LONG), "differs"), ("None", 3, "intact")])
    empty = warc.write_warc(pages.limit(0))
    assert warc.audit(empty, warc.copy_files(empty, F.lit(True))).collect() == []


def test_warc_descends_to_the_damage(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 20).alias("html"))
    records = warc.write_warc(pages)
    bad = {7, 8, 1999, 2999}
    got = warc.audit(records, warc.copy_files(records, F.col("page_id").isin(*bad)))
    assert {r.page_id for r in got.filter("status = 'differs'").collect()} == bad and got.count() == 3000
    member = warc.record(5, "http://h/5", b"body")
    headers, body = warc.parse(member)
    assert body == b"body" and headers["X-Page-ID"] == "5" and warc.check_payload(warc.flip(member))[1] is False


def test_warc_replicas_that_lack_records_or_files(spark):
    """16 records against 17 (other depths), a lost file, a cut one, and records that only the replica has."""
    pages = spark.range(17).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.repeat(F.lit("x"), 50).alias("html"))
    records = warc.write_warc(pages.coalesce(1), file_bytes=1 << 30)
    copies = warc.copy_files(records, F.lit(False))
    said = lambda got: dict(Counter(r.status for r in got.collect()))
    assert said(warc.audit(records, copies)) == {"intact": 17}
    last = copies.groupBy("file").agg(F.max("ord").alias("ord")).orderBy(F.desc("ord")).limit(1)
    short = copies.join(last, ["file", "ord"], "left_anti")
    assert said(warc.audit(records, short)) == {"intact": 16, "missing": 1}
    fewer = records.join(last, ["file", "ord"], "left_anti")
    assert said(warc.audit(fewer, copies)) == {"intact": 16, "added": 1}
    paths = copies.groupBy("path").count().orderBy(F.desc("count"), "path").collect()
    lost = paths[0]["path"].replace("file:", "").replace("//", "/") if paths[0]["path"].startswith("file:") else paths[0]["path"]
    want = {k: v for k, v in {"intact": 17 - paths[0]["count"], "differs": paths[0]["count"]}.items() if v}
    with open(lost, "r+b") as f:
        f.truncate(10)
    assert said(warc.audit(records, copies)) == want
    os.remove(lost)
    assert said(warc.audit(records, copies)) == want


def test_warc_files_are_cut_between_records(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.md5(F.col("id").cast("string")).alias("html"))
    records = warc.write_warc(pages, file_bytes=500)
    assert records.select("file").distinct().count() > 8 and records.count() == 40
    got = warc.audit(records, warc.copy_files(records, F.col("page_id") == 11)).collect()
    assert {r.page_id for r in got if r.status == "differs"} == {11} and len(got) == 40


# ---- 7 and 9


@pytest.mark.parametrize("module,run,column", [(quality, quality.quality, "quality"), (toxicity, toxicity.toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, run, column):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    is_one, said_one = known[column] == 1, known.predicted == 1
    # A constant score fails one of these.
    assert 0 < is_one.sum() < len(known)
    assert said_one[is_one].mean() >= 0.8 and is_one[said_one].mean() >= 0.8 and (~said_one)[~is_one].mean() >= 0.9


def test_toxicity_ratios_like_plain_kneser_ney(spark):
    """The columns against a plain statement of the interpolated models."""
    toxic = ["you idiot", "bad idiot here", "you clown", "you bad bad"]
    ordinary = ["good day here", "you are here", "a good good day", "bad day", "clown shoes", "a b c"]
    texts = toxic + ordinary
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1], "doc_id long, label int")
    kept = {r.doc_id for r in labels.collect()}
    n = [Counter(w for i in kept if (i < 4) == c for w in set(texts[i].split())) for c in (False, True)]
    both = n[0] + n[1]
    estimate = lambda c: (ones / (ones + 2 * twos) if (ones := sum(v == 1 for v in c.values())) and (twos := sum(v == 2 for v in c.values())) else 0.75)
    weight = toxicity.SHARED * min(sum(c.values()) for c in n)

    def p(c, w):
        low = max(both[w] - estimate(both), 0) / sum(both.values()) + estimate(both) * len(both) / (len(both) + 1) / sum(both.values())
        return (max(n[c][w] - estimate(n[c]), 0) + (estimate(n[c]) * len(n[c]) + weight) * low) / (sum(n[c].values()) + weight)

    ratios, unknown = toxicity.word_ratios(toxicity.word_counts(docs, labels))
    got = {r.word: r.ratio for r in ratios.collect()}
    assert got.keys() == both.keys() and all(abs(v - np.log(p(1, w) / p(0, w))) < 1e-9 for w, v in got.items())
    assert abs(unknown - np.log(p(1, "never") / p(0, "never"))) < 1e-9
    for c in (0, 1):  # each model's probabilities, with one unknown word, sum to 1
        assert abs(sum(p(c, w) for w in both) + p(c, "never") - 1) < 1e-9


def test_attention_gradient():
    """Fitting follows the loss's gradient: finite differences of the loss agree with the first step's direction."""
    r = np.random.default_rng(0)
    x, who, label = r.normal(size=(30, 6)), np.repeat(np.arange(10), 3), np.arange(10) % 2.0
    first = np.flatnonzero(np.diff(who, prepend=-1))
    model = quality.Attention(6, 4)
    weight = np.full(10, 0.1)
    grad = model.gradient(x, first, who, label, weight)

    def loss():
        y = model._forward(x, first, who)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum()

    for k, p in model.p.items():
        for at in list(np.ndindex(p.shape))[:5]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-6, k


def test_quality_learns_from_words_and_all_passages(spark):
    """The label hangs on words in one passage of many, far from the beginning."""
    r = np.random.default_rng(3)
    common, good = random_words(r, 60, 6), random_words(r, 8, 6)
    ids = range(600)
    texts = []
    for i in ids:
        w = list(r.choice(common, 48 * 12))
        if i % 2:
            w[48 * (i % 12) : 48 * (i % 12) + 48] = r.choice(good, 48)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = quality.quality(docs, labels).filter("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) >= 0.95


@pytest.mark.parametrize("run,column", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_odd_rows(spark, run, column):
    docs = odd_docs(spark)
    for given in ([], [(1, 1)], [(i, i % 2) for i in range(20)] + [(5, 0), (None, 1), (6, None), (7, 9)]):
        labels = spark.createDataFrame([(i, v, "t") for i, v in given], f"doc_id long, {column} int, text string")
        got = run(docs, labels).collect()
        assert len(got) == len(ODD_TEXTS) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        assert run(docs.limit(0), labels).collect() == []
        again = run(docs, labels).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_ignores_held_out_labels(spark):
    docs, labels = docs_of(spark), docs_of(spark, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, quality.quality(docs, labels).collect())) == sorted(map(str, quality.quality(docs, turned).collect()))


def random_words(r, n, size=12):
    return ["".join(w) for w in r.choice(list("abcdefghijklmnopqrstuvwxyz"), (n, size))]


@pytest.mark.parametrize("kind", ["rare", "ending"])
def test_toxicity_knows_rare_words_and_endings(spark, kind):
    """Words that two counted documents hold, and words that differ only behind the ninth letter."""
    r = np.random.default_rng(11)
    common, ids = random_words(r, 40), np.arange(1500)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    toxic = r.random(len(ids)) < 0.5
    own = [[] for _ in ids]
    for k in (False, True):
        counted, rest = ids[(toxic == k) & (fold > 1)], ids[(toxic == k) & (fold < 2)]
        for n, word in enumerate(random_words(r, len(rest) * 4)):
            for i in (*r.choice(counted, 2, replace=False), rest[n % len(rest)]):
                own[i].append(word if kind == "rare" else "unbelievable" + ("nasty" if k else "charming"))
    texts = [" ".join([*r.choice(common, 40), *w]) for w in own]
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(ids, texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(int(i), int(t)) for i, t in zip(ids, toxic)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(docs, labels).filter("held_out").collect()}
    assert np.mean([got[i] == toxic[i] for i in got]) >= 0.9


# ---- 8


def test_mixing_meets_targets(spark):
    got = mixing.mix(docs_of(spark)).join(docs_of(spark).select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.t - r.g) <= r.m and r.over <= 0
    copies = {r.doc_id: r.copies for r in got.collect()}
    assert Counter(r.doc_id for r in mixing.mixed(docs_of(spark)).collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ODD_TEXTS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "a b", "s")] * 5 + [(2, "c", None)], "doc_id long, text string, source string")
    assert len({r.copies for r in mixing.mix(same).filter("doc_id = 1").collect()}) == 1


# ---- 10


def brute_classes(texts):
    grams = [shingle_counts(t)[1] for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if grams[i] and grams[j] and similarity(grams[i], grams[j]) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_like_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in docs_of(spark).collect())
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark)).collect()}
    want = brute_classes([t for _, t in rows])
    assert got == {rows[i][0]: rows[w][0] for i, w in enumerate(want)}


def test_near_copies_of_one_text(spark):
    """A dense group on both sides of the threshold: its classes are those of brute force."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        w = list(base)
        for i in r.choice(150, r.integers(0, 8), replace=False):
            w[i] = f"new{k}x{i}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(frame).collect()}
    assert got == dict(enumerate(brute_classes(texts)))
    kept = minhash.deduplicated(frame).count()
    assert kept == len(set(got.values()))


def test_signatures_estimate_weighted_similarity():
    a, b = Counter({i: 1 + i % 4 for i in range(300)}), Counter({i: 1 + i % 4 for i in range(60, 330)})
    true = similarity(a, b)
    keys = np.array([hash(("k", i)) & (2**63 - 1) for i in range(330)], np.uint64)
    s = np.concatenate([keys[list(c)] for c in (a, b)])
    who = np.repeat([0, 1], [len(a), len(b)])
    sig = minhash.signatures(s, who, np.array([*a.values(), *b.values()]), 2)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / minhash.COORDINATES)


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ODD_TEXTS)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    words = Counter(t for t in (r.text for r in kept.collect()) if t and t.strip())
    assert max(words.values()) == 1 and LONG in words
    assert sum(1 for r in kept.collect() if not (r.text or "").strip()) == 3  # texts without words stay
    assert minhash.near_duplicates(docs.limit(0)).collect() == [] and minhash.deduplicated(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, PROSE[0]), (1, PROSE[0]), (1, PROSE[1]), (2, PROSE[0])], "doc_id long, text string")
    assert sorted(r.text for r in minhash.deduplicated(twice).collect()) == sorted(PROSE[:2])


def test_texts_without_words_stay_whatever_else_ties(spark):
    blanks = [(1, x) for x in ("!!!", "", " \n", None) for _ in range(2)]
    for others in ([(2, PROSE[0]), (3, PROSE[0])], [(2, PROSE[0]), (2, PROSE[0])]):
        docs = spark.createDataFrame([*blanks, *others], "doc_id long, text string")
        left = [r.text for r in minhash.deduplicated(docs).collect()]
        assert left.count(PROSE[0]) == 1 and len(left) == len(blanks) + 1, others


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = docs_of(spark)
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == docs.columns, name
        frames.append(out.persist())
    ids = [{r.doc_id for r in f.collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    texts = [r.text for r in frames[2].orderBy("doc_id").collect()]
    assert len(set(brute_classes(texts))) == len(texts)
    leaks = {r.doc_id for r in decontaminate.matches(frames[2], docs_of(spark, "benchmark")).collect()}
    assert ids[3] == ids[2] - leaks
    final = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in final) == Counter(r.doc_id for r in frames[4].collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names the operators use inside."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = ["gone_id", "gone_th", "th", "leak", "src", "base", "below", "copy", "label_id", "__score", "root", "key", "grp", "size", "lot", "word", "id", "x", "n", "h"]
    odd = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    odd = odd.unionByName(odd.filter("doc_id = 4"))
    rows = lambda frame: Counter(map(str, frame.collect()))
    texts = lambda frame: Counter(r.text for r in frame.collect() if (r.text or "").strip())
    given = rows(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        kept = rows(out)
        assert set(kept) <= set(given), name
        if name == "near_duplicates":
            assert set(texts(out)) == set(texts(odd)) and max(texts(out).values()) == 1
        if name == "mix_sources":
            assert all(n <= 2 * given[r] for r, n in kept.items())
        if name == "decontamination":
            assert kept == given
    last = corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()
    assert len(last) == odd.count() and sum(r.n_tokens == 1 for r in last) == sum(n for r, n in Counter(r.text for r in odd.collect()).items() if not (r or "").strip())
