"""Extraction, language model and packing against plain versions; the pipeline."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from budgetlens.llm import html_blocks, kneser_ney, packing

PAGES = [
    (1, "u1", '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>'
              '<a href="/a">Home</a></li></ul></nav><div class="ad">Buy &amp; save now.</div><article><h1>A  title</h1>'
              "<p><b>First &eacute; line<br><p>Second,\n line of the text here.</p></article><footer>&copy; us</footer>"),
    (2, None, None), (None, "u3", ""), (4, "u4", "<p"), (4, "u4", "<p"),
    (5, "u5", "<body><main><p>" + "word " * 30000 + "</p></main></body>")]


@pytest.fixture(scope="module")
def labeller(spark):
    return html_blocks.train(spark.createDataFrame(PAGES, "page_id long, url string, html string"), composed=800, epochs=12)


def test_extract_main_text(spark, labeller):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, text string")
    got = [tuple(r)[:4] for r in html_blocks.extract(df, labeller).collect()]
    assert len(got) == len(PAGES)
    by = {g[0]: g for g in got}
    assert by[1][2] == "A title\nFirst é line\nSecond, line of the text here." and by[1][3] == len(by[1][2])
    assert by[2][2] == "" and by[None][2] == "" and by[4][3] == 0
    assert by[5][3] == 30000 * 5 - 1


@pytest.mark.parametrize("page, want", [
    ('<p>One</p><script src="a.js"/>var x=1;</script><p>Two', ["One", "Two"]),
    ("<script src=a/>var y</script><p>Three", ["Three"]),
    ("<style/>p{color:red}</style><p>Four", ["Four"]),
    ('<p>A <svg viewBox="0 0 1 1"/> b</p><svg><text>no</text></svg><p>c', ["A b", "c"]),
    ("<textarea/>typed</textarea><iframe/>frame</iframe>x", ["x"]),
    ("<p>one<br/>two<hr/>three", ["one two", "three"])])
def test_a_slash_ends_no_raw_text_element(page, want):
    assert [b.text for b in html_blocks.blocks_of(page)] == want


def test_a_slash_closes_no_block():
    (block,) = html_blocks.blocks_of('<div class="ad"/>inside</div>')
    assert block.text == "inside" and ".ad" in block.path


def test_labeller_generalises_to_unseen_pages(labeller):
    composer = html_blocks.Composer(["alpha", "beta", "gamma", "delta.", "of", "the"], 77)
    data = [html_blocks.labelled(composer.page()) for _ in range(120)]
    out = html_blocks.label_pages(labeller, [b for b, _ in data], {})
    right = sum(int(((p >= 0.5) == (y > 0.5)).sum()) for p, (_, y) in zip(out, data, strict=True))
    assert right / sum(len(y) for _, y in data) > 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = html_blocks.Lstm(hidden=3, dim=5, inner=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = net.forward(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = net.gradients(x, mask, y)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        old, eps = v[at], 1e-4
        v[at] = old + eps
        up = loss()
        v[at] = old - eps
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=1e-5), k


def plain_kn(train, order):
    """Score function of an interpolated modified Kneser-Ney model over lists of tokens."""
    counts = {order: Counter()}
    for t in train:
        seq = ["<s>"] * (order - 1) + t
        for k in range(len(t)):
            counts[order][tuple(seq[k:k + order])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    vocabulary = {w for t in train for w in t}
    disc, ctx = {}, {}
    for n, c in counts.items():
        nn = Counter(c.values())
        disc[n] = (0, *kneser_ney.discounts(*(nn[k] for k in (1, 2, 3, 4))))
        ctx[n] = defaultdict(lambda: [0, 0, 0, 0])
        for g, v in c.items():
            x = ctx[n][g[:-1]]
            x[0] += v
            x[min(v, 3)] += 1

    def p(gram):
        n = len(gram)
        low = p(gram[1:]) if n > 1 else 1 / (len(vocabulary) + 1)
        x = ctx[n].get(gram[:-1])
        if not x:
            return low
        c = counts[n].get(gram, 0)
        return (max(c - disc[n][min(c, 3)], 0) + sum(disc[n][k] * x[k] for k in (1, 2, 3)) * low) / x[0]
    return p, vocabulary


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_plain_model(awkward, rows, order):
    def tokens(t):
        return [*(t or "").encode().lower().split(), "</s>"]
    bucket = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    train = [tokens(t) for i, t in rows if bucket(i)]
    p, _ = plain_kn(train, order)
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in kneser_ney.held_out_scores(awkward, order).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        ts = tokens(t)
        seq = ["<s>"] * (order - 1) + ts
        want = sum(math.log10(p(tuple(seq[k:k + order]))) for k in range(len(ts)))
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
        assert any(r["score"] == pytest.approx(want, abs=1e-6) and r["base_score"] == pytest.approx(base, abs=1e-6)
                   and r["n_tokens"] == len(ts) and r["n_known"] == sum(c[w] > 0 for w in ts)
                   and r["held_out"] == (bucket(i) == 0) and r["train_tokens"] == n for r in got[i])


def test_probabilities_sum_to_one(awkward):
    model = kneser_ney.train(awkward, 2)
    maps, tokens = model.maps(), kneser_ney.Tokens()
    words = sorted({w for r in awkward.collect() for w in (r["text"] or "").encode().lower().split()})
    h = np.concatenate([tokens.hashes.of_texts([b" ".join(words)])[0], [kneser_ney.END, np.uint64(12345)]])
    context = np.full(len(h), h[0])
    assert model.probabilities(maps, [context, h]).sum() == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("step", ["score", "count"])
def test_arrays_of_a_chunk_stay_few(awkward, words, monkeypatch, step):
    """Peak of a task's arrays for 4 MB of text, in arrays of one number a token."""
    model = kneser_ney.train(awkward, 2)
    monkeypatch.setattr(kneser_ney, "map_batches", lambda df, fn, *_, **__: fn)
    run = (kneser_ney.score(awkward, model, F.lit(True)) if step == "score"
           else kneser_ney.counted(awkward, 2, model.layout[2]))
    rng = random.Random(8)
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(240)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(240)), "held_out": [True] * 240, "text": texts})
    tracemalloc.start()
    try:
        made = run(batch)
        n = sum(map(len, [made["score"]] if step == "score" else [c["blob"] for c in made]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n and peak < 14 * 8 * 240 * 3001, peak / (8 * 240 * 3001)


def test_packing_round_trip(awkward, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(awkward, with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    assert all(r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["length"] <= 4096 for r in got)
    want = Counter()
    for i, t in rows:
        a = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for s, n in packing.pieces(len(a), 4096):
            want[i, s, n, zlib.crc32(np.array(a[s:s + n], "<u4").tobytes()), len(a)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want


@pytest.mark.parametrize("text", [
    "It's DON'T a.b.c! (x) [y] \"z\" 12,5% -- é. naïve, ÇA?! ΟΔΟΣ. İstanbul", "<|endoftext|> a<|endoftext|>b.",
    "á. café! ​  x  \x1c \x85 tab\tnl\n", "", "ﬁ ½ ² ª º µ 中文。日本 😀!", "x" * 3000 + "."])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    got = [x.tolist() for x in packing.Encoder(path).ids(["pre fix", text, "post"])]
    assert got[1] == want


def test_pieces_cover_and_are_powers_of_two():
    for n in (*range(1, 70), 4095, 4096, 4097, 12345):
        ps = packing.pieces(n, 4096)
        assert sum(k for _, k in ps) == n and all(k & (k - 1) == 0 for _, k in ps)
        assert [s for s, _ in ps] == list(np.cumsum([0, *(k for _, k in ps)])[:-1])


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_blocks.extract(pages).count() == 0
    assert kneser_ney.held_out_scores(empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_pipeline_stages(spark, awkward, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = next(r["text"] for r in awkward.collect() if r["doc_id"] == 11)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == awkward.columns
        sizes.append(docs.count())
    ids = {r["doc_id"] for r in docs.collect()}
    assert 11 not in ids and 100 not in ids and {0, 301} & ids
    assert sizes == sorted(sizes, reverse=True)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids
