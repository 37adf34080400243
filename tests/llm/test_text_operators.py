"""Extraction, archives, toxicity, SpotSigs and the pipeline."""

import hashlib
import html as entities
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import archives, spotsigs
from hushframe.llm.boosting import fit_boosted, fit_isotonic, sigmoid
from hushframe.llm.html_text import extract, main_text, smoothed
from hushframe.llm.toxicity import HELD_OUT, drop_toxic, fit, fold, op5_toxicity, scored
from hushframe.session import fresh_path


# -- extraction -----------------------------------------------------------------------------------------------


def test_articles_of_given_pages(spark, sf):
    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside))
        assert r.text == "\n".join(b for b in blocks if b)


LONG = "These words are the text of the page, and there are enough of them to be one. " * 3


@pytest.mark.parametrize("page", [
    "<div id=content class='post with-sidebar'><h1>T</h1><p>{0}</p><p>s &amp; t</p></div><div class=sidebar><p>{1}</p></div>",
    "<header><h1>Site</h1></header><main><h1>T</h1><p>{0}<p>s &amp;\n t</main><aside><p>{1}</p></aside><footer>{1}</footer>",
    "<nav><ul><li><a href=/>{1}</a></ul></nav><div class=page><h1>T</h1><section><p>{0}</p></section><section><p>s &#38; t</p></section></div>",
    "<article><header><h1>T</h1></header><p>{0}</p><div class='ad-slot ads'>{1}</div><form><p>{1}</p></form><p><b>s</b> &amp; t</p><section id=comments><p>{1}</p></section></article>",
    "<div role=alert>{1}</div><div hidden>{1}</div><article><h1>T</h1><p>{0}<script>x = '<p>{1}'</script></p><p>s<!-- {1} --> &amp; t</p></article><article class=teaser><p>{1}</p></article>",
])
def test_only_the_text_is_left(page):
    assert main_text("<html><head><title>x</title></head><body>" + page.format(LONG, "Other. " * 20)) == f"T\n{LONG.strip()}\ns & t"


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<![if IE]><!-- x") .replace("<!-- x", "") == ""
    assert main_text("plain  text here") == "plain text here" and main_text("<form><p>only</p></form>") == "only"
    assert main_text("<![foo bar[>x<p>y") == "x\ny"
    assert smoothed(np.array([3.0])).tolist() == pytest.approx([3.0])
    df = spark.createDataFrame([(1, None, "t"), (None, "<p>a</p>" * 3000, "t")], "page_id int, html string, text string")
    assert sorted(len(r.text) for r in extract(df).collect()) == [0, 5999] and extract(df).columns == ["page_id", "text"]
    assert extract(df.limit(0)).count() == 0


# -- archives -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    rng = random.Random(version)
    pages = [(i, f"http://h/{i} ü", rng.choice(["same", "", "WARC/1.1\r\n\r\nfiledesc://x\n", f"<p>{i}\r\n\r\né"])) for i in range(40)]
    pages += [(7, "u", pages[7][2]), (None, None, "same"), (99, "", None)]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id bigint, url string, html string, offset int, digest string").repartition(3)
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    archives.write_arc(df, arc, version)
    archives.arc_to_warc(spark, arc, warc)
    rows = archives.read_warc(spark, warc, payloads=True).collect()
    assert len(rows) == len(pages) == len({r.record_id for r in rows})
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    payload = {i: h or "" for i, _, h in pages}
    for r in rows:
        text = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), archives.base32_sha1(text.encode()))
        if r.record_type == "response":
            assert r.page_id == least[text] and r.refers_to is None and r.payload == text.encode()
        else:
            assert r.refers_to == least[text] and r.payload == b""
    assert sum(r.record_type == "response" for r in rows) == len(least)
    archives.arc_to_warc(spark, arc, warc + "-large", least=10)
    assert all(r.record_type == "response" for r in archives.read_warc(spark, warc + "-large").collect() if r.payload_bytes < 10)


def test_empty_archive_and_bad_files(spark):
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    archives.write_arc(spark.createDataFrame([], "page_id bigint, url string, html string"), arc)
    archives.arc_to_warc(spark, arc, warc)
    assert archives.read_warc(spark, warc).count() == 0
    block = archives.arc_version_block(1, "n", "20250101000000") + b"\n"
    assert [r.payload for r in archives.arc_records(block + b"http://a 1.2.3.4 20250101000000 text/plain 5\nab\ncd\n")] == [b"ab\ncd"]  # no HTTP headers
    for bad in (b"http://a 0 0 t 1\nx", block + b"http://a 1.2.3.4 20250101000000 text/plain 50\nab", block.replace(b"1 0 origin", b"7 0 origin")):
        with pytest.raises(archives.ArchiveError):
            list(archives.arc_records(bad))


# -- toxicity -------------------------------------------------------------------------------------------------


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_boosted(x[:2000], y[:2000])
    assert ((sigmoid(model.raw(x[2000:])) > 0.5) == y[2000:]).mean() > 0.95
    steps = fit_isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert steps.values.tolist() == pytest.approx([0, 1 / 3, 1]) and np.all(np.diff(steps(np.linspace(-3, 6, 50))) >= 0)
    assert fit_boosted(x[:5], np.ones(5)).trees == [] and len(fit_boosted(x[:0], y[:0]).raw(x)) == 3000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.9 and (clean.predicted == 1).mean() < 0.02
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean() > 0.98


def test_toxicity_uses_no_held_out_label(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(fold("doc_id") == HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", None]
    assert fit(docs, labels).score(texts).tolist() == fit(docs, flipped).score(texts).tolist()


def test_toxicity_of_odd_tables(spark):
    words = ["vile", "nice"]
    docs = [(i, f"{words[i % 2]} word{i} text", 0.5) for i in range(120)] + [(None, "vile", 0.5), (200, None, 0.5), (201, "", 0.5), (202, "VILE you v1le " * 20000, 0.5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int")
    model = fit(df, labels)
    left = drop_toxic(df, labels)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {i for i in range(1, 120, 2)} | {200, 201}
    assert not {r.doc_id for r in left.collect()} & ({i for i in range(0, 120, 2)} | {202, None})
    assert scored(df.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in scored(df, fit(df, none)).collect()} == {0.0}
    assert {r.score for r in scored(df, fit(df, labels.filter("toxic = 1"))).collect()} == {1.0}


# -- SpotSigs -------------------------------------------------------------------------------------------------


def brute_signs(text, common):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")
    marked, run = [(".", True)], 0
    for at, w in enumerate(words):
        if w in common:
            marked.append((w, True))
            run = 0
        else:
            if run == spotsigs.GAP:
                marked.append(("-", True))
                run = 0
            marked.append((w, False))
            run += 1
    out = set()
    for i, (w, is_anchor) in enumerate(marked):
        after = [x for x, a in marked[i + 1:] if not a][: spotsigs.CHAIN]
        if is_anchor and len(after) == spotsigs.CHAIN and "" not in after:
            out.add(" ".join([w, *after]))
    return out or set(words)


def test_signatures_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, "One", "the of", "a b c", "the cat sat on the mat of a dog", "É é; x_y 12 the\nend of it all"]
    texts += [" ".join(rng.choice(["the", "of", "cat", "Dog.", "sun", "moon", "é!", "sky"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    df = spotsigs.with_signatures(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "signs", ["the", "of"])
    for r in df.collect():
        plain = brute_signs(r.text, {"the", "of"})
        assert r.signs == sorted(spark_hashes(spark, plain))


def spark_hashes(spark, strings):
    import xxhash

    return {xxhash.xxh64_intdigest(s.encode(), 42) & 0xFFFFFFFF for s in strings}


def test_next_and_edited(spark, sf, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS", 7)  # many ranges of ids
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id * 1000 if r.doc_id == 199 else r.doc_id, r.text) for r in rows] + [(None, "last")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id bigint, text string, range string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    expected = {i: (t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)}
    got = spotsigs.with_next(df).collect()
    assert len(got) == len(rows) and {r.id: (r.text, r.next_text) for r in got} == expected
    one = spotsigs.with_next(df.limit(1)).collect()
    assert len(one) == 1 and one[0].text == one[0].next_text
    assert spotsigs.with_next(df.limit(0)).count() == 0


def test_op3_edits(spark, sf):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.op3_spotsigs(spark, sf).collect()}
    by_text = {}
    for k, (i, t) in enumerate(rows):
        n = len(t) // 3
        edited = t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97


def test_similar_documents(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(8)]
    texts = []
    for b in base:
        for k in range(4):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(60)] = "new"
            texts.append(" the ".join(w))
    texts += [texts[0], "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    members, links = spotsigs.similar_documents(df, 0.7, ["the"])
    sets = {i: brute_signs(t, {"the"}) for i, t in enumerate(texts)}
    prints = {r.id: r.print for r in members.collect()}
    assert len(prints) == len(texts) and prints[0] == prints[32]
    expected = set()
    for i in sets:
        for j in sets:
            if prints[i] < prints[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7:
                expected.add((prints[i], prints[j]))
    assert {tuple(sorted((r.print_a, r.print_b))) for r in links.collect()} == expected and expected


# -- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, "stage")
        stage(spark, kept, sf).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        counts.append(len(ids))
        if name in ("exact dedup", "simhash near-dedup"):
            assert len({texts[i] for i in ids}) == len(ids)
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert key(packed) == key(whole)
