"""Each operator against brute force, and with nulls, empty and repeated rows, clashing names, empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdecide.llm import bpe, chat, components, decontaminate, html, langid, media, neardup, quality, store, suffix
from sparkdecide.llm.catalog import tokenizer_path

DOCS = "doc_id long, text string"
WORD_PATH, BYTE_PATH = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = ["", None, " \n\t ", "a", "don't WE'LL!! 's", "Ünïcode  ñandú İstanbul", "x" * 500, "日本語" * 90, "<|endoftext|> a <|startoftext|>", "ab " * 4000, "tab\there", "same", "same"]


def words(r, n, pool):
    return " ".join(r.choice(pool) for _ in range(n))


def pool(r, n=400):
    return ["".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]


def frame(spark, texts):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in enumerate(texts)], DOCS + ", row int, name string, score double")


# --- language ID and quality


def test_language_id(spark):
    r = random.Random(1)
    pools = {k: pool(random.Random(k)) for k in ("xx", "yy", "zz")}
    data = [(k, words(r, r.randint(5, 60), p)) for k, p in pools.items() for _ in range(60)]
    m = langid.train([t for _, t in data], [k for k, _ in data])
    new = [(k, words(r, 20, p)) for k, p in pools.items() for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(new)] + [(98, None), (99, "12 34 !!")], DOCS)
    got = {x.doc_id: x.p for x in df.select("doc_id", langid.prediction(F.col("text"), m).alias("p")).collect()}
    assert sum(got[i].lang_pred == k for i, (k, _) in enumerate(new)) >= 58
    assert got[98].lang_pred == got[99].lang_pred == "und" and got[98].rejected and got[99].score == 0
    assert all(0 <= v.score <= 1 for v in got.values())
    strange = m.probabilities(["щщщ жжжжж ййййй цццц"])
    assert strange.max() < 0.9


def test_language_id_takes_no_null_labels(spark):
    with pytest.raises(ValueError, match="labelled"):
        langid.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))


def test_quality_learns_bytes():
    r = random.Random(3)
    p = pool(r)
    good = [words(r, r.randint(20, 90), p).encode() for _ in range(120)]
    bad = [(words(r, 30, p) + " ###$$$" * 20).encode() for _ in range(120)]
    m = quality.train(good[:80] + bad[:80], [1] * 80 + [0] * 80)
    s = m.scores(good[80:] + bad[80:] + [b"", b"x" * 10_000])
    assert (s[:40] >= 0.5).mean() > 0.95 and (s[40:80] < 0.5).mean() > 0.95
    assert len(s) == 82 and ((s >= 0) & (s <= 1)).all()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 448, 449, 1000])
def test_chunks_cover_the_whole_text(n):
    data = bytes(k % 251 for k in range(n))
    rows = quality.cut(data)
    covered = bytearray(len(rows) * quality.STEP + quality.CHUNK)
    for k, row in enumerate(rows):
        covered[k * quality.STEP : k * quality.STEP + quality.CHUNK] = row.tobytes()
    assert bytes(covered[:n]) == data


# --- tokens


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab the's\n\t ,.!?*-_019ABñÉ日…́=İσΣ\xa0", max_size=300))
def test_encoding_equals_the_library(text):
    for path in (WORD_PATH, BYTE_PATH):
        e = bpe.encoder(path)
        assert np.frombuffer(e.encode([text])[0], np.int32).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinst", min_size=60, max_size=700))
def test_tree_concatenation_of_unsplit_text(text):
    e = bpe.encoder(WORD_PATH)
    assert [i for p in e.long_unit(text) for i in p] == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_of_whole_documents_and_of_pieces(spark):
    r = random.Random(5)
    texts = [*ODD, words(r, 900, pool(r)), "".join(r.choice("aeinst") for _ in range(5000)), words(r, 300, pool(r)) + "q" * 3000 + " end"]
    texts += ["日本語文字" * 700, "привет" * 600, "<|endoftext|>" * 300, words(r, 300, pool(r)) + "<|endoftext|>" + "".join(r.choice("xyzst") for _ in range(3000)) + "<|endoftext|>end"]
    texts += ["it'restless'llama'verity" * 120, "1234567890" * 400, "!?" * 1500]
    for path in (WORD_PATH, BYTE_PATH):
        e = bpe.encoder(path).tokenizer
        got = bpe.encode(frame(spark, texts).withColumn("ids", F.lit(1)), path, split_chars=1000, decoded_col="back").collect()
        assert len(got) == len(texts)
        for x in got:
            ids = e.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
            assert x.ids == ids and x.back == e.decode(ids, skip_special_tokens=False), texts[x.doc_id][:80]
    assert bpe.encode(spark.createDataFrame([], DOCS), WORD_PATH).count() == 0
    ids = spark.createDataFrame([([5, 6],), (None,), ([],)], "ids array<int>")
    e = bpe.encoder(WORD_PATH).tokenizer
    assert [x.t for x in ids.select(bpe.decoded(F.col("ids"), WORD_PATH).alias("t")).collect()] == [e.decode([5, 6], skip_special_tokens=False), None, ""]


def test_store_round_trip(spark):
    r = random.Random(6)
    p = pool(r)
    shared = words(r, 1500, p)
    texts = [*ODD, shared, shared, words(r, 50, p) + " " + shared, shared + " " + words(r, 700, p)]
    written = store.write_store(store.encode_documents(frame(spark, texts).repartition(3), BYTE_PATH))
    got = {x.doc_id: x for x in store.read_store(written).join(store.starts(written), "row").collect()}
    at, e = 0, bpe.encoder(BYTE_PATH).tokenizer
    for k, t in enumerate(texts):
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert (got[k].start, got[k].n_tokens) == (at, len(ids))
        at += len(ids)
    kept = sum(len(x.ids) for x in written.filter("kind <> 'pack'").collect())
    assert kept < 2 * at * 0.7  # the shared passage is stored once, in two bytes an id
    addresses = [x.address for x in written.filter("kind = 'chunk'").collect()]
    assert len(addresses) == len(set(addresses)) > 0
    roots = {x.pack: x.root for x in written.filter("kind = 'pack'").collect()}
    for pack, root in roots.items():
        docs = written.filter((F.col("kind") == "doc") & (F.col("pack") == pack)).orderBy("doc_id", "row").collect()
        assert store.merkle_root([x.root for x in docs]) == root


def test_store_notices_damage(spark):
    written = store.write_store(store.encode_documents(frame(spark, ["some text", "other text"]), BYTE_PATH))
    bad = written.withColumn("ids", F.when(F.col("doc_id") == 1, F.lit(b"\0\0")).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="differs"):
        store.read_store(bad).collect()


def test_chunks_follow_content():
    r = np.random.default_rng(1)
    ids = r.integers(0, 50000, 20000)
    a = {ids[i:j].tobytes() for i, j in zip([0, *store.cuts(ids)[:-1]], store.cuts(ids))}
    moved = np.concatenate([r.integers(0, 50000, 777), ids])
    b = {moved[i:j].tobytes() for i, j in zip([0, *store.cuts(moved)[:-1]], store.cuts(moved))}
    assert len(a & b) > 0.8 * len(a)


# --- duplicates


def sets_of(text, k):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("limits", [(256, 512), (4, 6)])
def test_near_duplicates(spark, k, limits, monkeypatch):
    monkeypatch.setattr(neardup, "NEAR", limits[0])
    monkeypatch.setattr(neardup, "BLOCK", limits[1])
    r = random.Random(k)
    p = pool(r)
    base = [words(r, r.randint(6, 80), p).split() for _ in range(25)]
    texts = list(ODD)
    for b in base:
        for _ in range(r.randint(1, 14)):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 18))):
                c[r.randrange(len(c))] = r.choice(p)
            texts.append(" ".join(c).title() if r.random() < 0.2 else " ".join(c))
    got = {x.doc_id: x for x in neardup.near_duplicates(frame(spark, texts).repartition(3), k).collect()}
    s = [sets_of(t, k) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        new = [min([low[i], *(low[j] for j in range(len(s)) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]))]) for i in range(len(s))]
        if new == low:
            break
        low = new
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s[i]), low[i], low[i] == i) for i in range(len(texts))]
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS), k).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c")], DOCS), k).filter("kept").count() == 2


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges[:-1] for x in e}
    for _ in range(100):
        for a, b in edges[:-1]:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {x: v for x, v in low.items() if any(x in e and e[0] != e[1] for e in edges[:-1])}


def removed_by_hand(texts, n):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if count[d[i : i + n]] > 1:
                gone[i : i + n] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1 << 19, 300])
def test_suffix_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    r = random.Random(4)
    p = pool(r, 3000)
    shared = [words(r, 30, p) for _ in range(4)]
    texts = [*ODD, "ab" * 300, words(r, 60, p) + " é " + "é" * 100]
    for _ in range(40):
        parts = [words(r, r.randint(0, 30), p)] + [x for x in shared if r.random() < 0.3] + [words(r, r.randint(0, 30), p)]
        texts.append(" ".join(parts))
    texts += texts[-3:]
    got = {x.doc_id: x for x in suffix.digests(frame(spark, texts), 60).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == removed_by_hand(texts, 60)
    assert all((got[i].text.encode() == (texts[i] or "").encode()) == (got[i].n_removed == 0) for i in range(len(texts)))
    assert suffix.digests(spark.createDataFrame([], DOCS), 60).count() == 0


def test_suffix_order_says_where_its_symbols_end():
    with pytest.raises(ValueError, match="too many"):
        suffix.suffix_order(np.arange(1 << 17, dtype=np.int64))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=3, max_size=30), min_size=1, max_size=8, unique=True), st.integers(2, 6))
def test_interval_expansion(strings, n):
    data = [s.encode() for s in strings if len(s) >= n]
    if not data:
        return
    count = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    want = [[count[d[i : i + n]] > 1 for i in range(len(d) - n + 1)] for d in data]
    assert [f.tolist() for f in suffix.repeated_windows(data, [1] * len(data), n)] == want


# --- decontamination


ITEM = "Alice has 12 apples and gives 5 apples to her friend near the old river before walking 3 miles home again"


def leak_rows(spark, texts, items=(ITEM,)):
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, row int")
    return {x.doc_id: x for x in decontaminate.leaks(frame(spark, texts), b).collect()}


def test_decontamination(spark):
    r = random.Random(2)
    clean = [words(r, 80, pool(r)) for _ in range(10)]
    other = ITEM.replace("Alice", "Bob").replace("12", "31").replace("miles", "km")
    mixed = ITEM.replace("gives 5", "gives Carol")
    texts = [*ODD, *clean, f"{clean[0]} {ITEM}. {clean[1]}", other, ITEM.upper(), mixed, ITEM]
    n = len(ODD) + len(clean)
    got = leak_rows(spark, texts)
    assert set(got) == {n, n + 1, n + 2, n + 4}
    assert [got[k].kind for k in (n, n + 1, n + 2, n + 4)] == ["verbatim", "re-parameterised", "verbatim", "verbatim"]
    assert leak_rows(spark, texts, (None, "", "too short")) == {}
    assert decontaminate.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_slots_have_to_agree(spark):
    item = "then Alice met the man and Alice saw the dog and Alice took the bus and Alice went to town"
    fine = item.replace("Alice", "Dora")
    odd = item.replace("Alice", "Dora", 1).replace("Alice", "Emma", 1).replace("Alice", "Fay", 1).replace("Alice", "Gus", 1)
    got = leak_rows(spark, [fine, odd], (item,))
    assert set(got) == {0} and got[0].kind == "re-parameterised"


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/a>A</a><li><a>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class=ad>Buy</div><article class="post"><h1>{0}</h1><p>One &amp; <b>two</b>
 three<br>four</p><p>Fish &eacute; &#x41;<p>Last {1}<script>var x = "</p>";</script><div class="share"><a>Share</a></div></article>
<aside>Side</aside><section class="comments"><p>I agree</p></section><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(k, "http://h.example/a", PAGE.format(f"Head {k}", "x" * k)) for k in range(1, 9)]
    rows += [(20, "http://h.example/a", None), (21, None, PAGE.format("Q", "z")), (22, "http://k.example", "<div><p>Plain <i>text</i></p>more<p>end"), (23, "http://k.example", ""), (24, "http://h.example/a", rows[0][2])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, host string")
    got = {x.page_id: x for x in html.main_text(df).collect()}
    assert got[3].text == "Head 3\n\nOne & two three four\n\nFish é A\n\nLast xxx" and got[3].n_chars == len(got[3].text)
    assert got[20].text == got[23].text == "" and got[21].text.startswith("Q\n\nOne & two")
    assert got[22].text == "Plain text\n\nmore\n\nend" and got[24].text == got[1].text
    assert html.main_text(df.limit(0)).count() == 0


def test_wrappers_find_groups_and_options():
    a, b = "<ul><li>x</li></ul><p>t</p>", "<ul><li>x</li><li>y</li></ul><h2>u</h2><p>t</p><p>v</p>"
    w = html.infer([a, b])
    assert [(c["s"], c["q"]) for c in w["c"]] == [("ul.", "1"), ("h2.", "?"), ("p.", "+")]
    assert w["c"][0]["c"][0]["q"] == "+"


def test_deep_and_long_pages():
    assert html.read("<div>" * 400 + "deep" + "</div>" * 400, html.infer(["<div>x</div>"])) == "deep"
    assert len(html.read("<p>" + "word " * 100_000, html.infer(["<p>x"]))) == 499_999


# --- chats


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "hi </s> \\ [INST] <<SYS>>", 0.0), (1, 2, 1, "assistant", "a\n", 1.0), (1, 3, 1, "assistant", "b [/INST]", 5.0), (1, 4, 3, "user", None, 0.0),
        (1, 5, 4, "assistant", "\\", 0.0), (2, 1, None, "system", "s", None), (2, 2, 9, None, "lost", None), (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "user", "circle", 0.0), (None, 7, None, "tool", "n", 0.0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, node int, parent int, role string, text string, score double")
    chats = chat.format_chats(df)
    got = {(x.conv_id, x.leaf): x for x in chat.read_chats(chats).collect()}
    assert set(got) == {(1, 2), (1, 5), (2, 1), (2, 2), (None, 7)}
    assert [(t.role, t.text) for t in got[1, 5].turns] == [("user", "hi </s> \\ [INST] <<SYS>>"), ("assistant", "b [/INST]"), ("user", ""), ("assistant", "\\")]
    assert got[1, 5].loss_text == "b [/INST]\\" and got[1, 2].loss_text == "a\n" and got[None, 7].loss_text == ""
    assert [(t.role, t.text) for t in got[2, 2].turns] == [("", "lost")] and got[None, 7].turns[0].role == "tool"
    best = chat.format_chats(df, 1).filter("conv_id = 1").first()
    assert best.leaf == 5 and best.rank == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [(1, k, f"user{k % 3}", f"t{k}") for k in range(70)]
    c = chat.messages_by_turn(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = chat.read_chats(chat.format_chats(c)).first().turns
    assert [(t.role, t.text) for t in turns] == [(r[2], r[3]) for r in rows]


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text(alphabet="</s>[INST] \\SYROLEURN", max_size=40), min_size=1, max_size=6))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escaped(F.col("t")).alias("e")).select("t", "e", chat.unescaped(F.col("e")).alias("u"), F.regexp_count("e", F.lit(chat.CONTROL)).alias("n")).collect()
    assert all(x.t == x.u and x.n == 0 for x in got)


# --- media


def test_media_columns(spark):
    texts = [*ODD, "é" * 96, "a" * 192, "a" * 193]
    got = {x.doc_id: x for x in media.read_features(media.write_images(frame(spark, texts))).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        image = media.to_image(data)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (got[k].tail_crc32, got[k].media_bytes, got[k].media_sha256) == (zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest())
        assert len(got[k].feature) == 16
    assert got[11].feature == got[12].feature
    bad = spark.createDataFrame([(1, None), (2, b"no image"), (3, b"BM")], "id long, media binary").select(media.image_features(F.col("media")).alias("f"))
    assert bad.filter("f is not null").count() == 0


def test_area_resize():
    r = np.random.default_rng(3)
    plane = r.random((24, 36))
    assert np.allclose(media.area_resize(plane, 8, 9), plane.reshape(8, 3, 9, 4).mean(axis=(1, 3)))
    odd = media.area_resize(plane, 7, 5)
    assert abs(odd.mean() - plane.mean()) < 1e-9
    assert media.decode(b"P5 # note\n3 2\n255\n" + bytes(range(6))).shape == (2, 3, 1)
