"""Defined results that the given tables do not show: clashing names, repeated ids, ties, blocks without helpful markup."""

import pytest
from pyspark.sql import functions as F

from hushframe.llm import archives, spotsigs
from hushframe.llm.exact_dedup import exact_dedup, exact_groups
from hushframe.llm.html_text import extract, main_text
from hushframe.llm.mixing import mixed
from hushframe.llm.packing import Capacity, best_fit, pack_documents
from hushframe.llm.toxicity import drop_toxic, labelled_sample
from hushframe.session import fresh_path

LONG = "Long sentences make a paragraph that any reader would call text, and it goes on for quite a while. "


def test_stories_in_several_articles_and_their_headline():
    page = (f"<body><nav><a>menu</a></nav><main><h1>Head</h1><p>{LONG * 2}</p><article><p>{LONG * 3}</p><p>short</p></article>"
            f"<article><h2>Second</h2><p>{LONG * 3}</p></article><article><a>card</a><a>card</a></article></main><footer>f</footer></body>")
    p, q = (LONG * 3).strip(), (LONG * 2).strip()
    assert main_text(page) == f"Head\n{q}\n{p}\nshort\nSecond\n{p}"


def test_ratio_overrules_a_hint_but_not_comments():
    block = "".join(f"<p>{LONG}</p>" for _ in range(6))
    page = lambda name, inner: f"<body><article><p>{LONG * 3}</p><div class='{name}'>{inner}</div></article></body>"
    assert all(main_text(page(n, block)).count("\n") == 6 for n in ("legal", "search-results"))
    for name, inner in (("comments", block), ("cookie", block), ("legal", f"<p>{LONG}</p>"), ("share", "<a>one</a><a>two</a>" * 20), ("legal", f"<form>{block}</form>")):
        assert main_text(page(name, inner)) == (LONG * 3).strip()


def test_ratios_decide_where_markup_does_not_help():
    links = "<div><a>a</a> <a>b</a> <a>c</a></div>" * 6
    page = f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG}</p><p>x</p><p>{LONG}</p></div><div>{links}</div></body>"
    assert main_text(page).split("\n") == [LONG.strip(), LONG.strip(), "x", LONG.strip()]


def test_extract_with_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, "<p>hello</p>", "old", 2)], "`x.y` string, Id int, html string, Text string, `c0` int")
    out = extract(df)
    assert out.columns == ["x.y", "Id", "c0", "text"] and out.collect() == [("a", 1, 2, "hello")]


def test_archives_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE", 5_000)
    pages = spark.createDataFrame([(k, f"u{k}", "x" * (900 + k) if k % 50 else "y" * 20_000) for k in range(300)], "page_id bigint, url string, html string").coalesce(1)
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    archives.write_arc(pages, arc)
    archives.arc_to_warc(spark, arc, warc)
    for path in (arc, warc):
        sizes = [len(archives.gunzipped(r.content)) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
        assert len(sizes) > 40 and max(sizes) < 22_000
    rows = archives.read_warc(spark, warc).collect()
    assert sorted(r.page_id for r in rows) == list(range(300)) and sum(r.record_type == "revisit" for r in rows) == 5


def labelled(spark):
    rude, kind = "you stupid idiot moron trash", "the quiet river runs past green fields"
    rows = [(i, f"{rude if i % 2 else kind} number {i % 7}") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int")


def test_toxicity_with_clashing_names(spark):
    docs, labels = labelled(spark)
    wide = docs.select("doc_id", F.lit(1).alias("a.b"), F.lit(0.5).alias("score"), F.lit(2).alias("__score"), "text", F.lit("t").alias("TEXT"), F.lit(3).alias("Doc_Id"))
    out = drop_toxic(wide, labels)
    assert out.columns == wide.columns and 0 < out.count() < 120
    assert {tuple(r)[1:4] for r in out.collect()} == {(1, 0.5, 2)}
    assert drop_toxic(wide.limit(0), labels.limit(0)).count() == 0


def test_toxicity_sample_is_bounded_by_rows(spark):
    docs, labels = labelled(spark)
    many = docs.withColumn("doc_id", F.col("doc_id") % 10).unionByName(docs).crossJoin(spark.range(50)).drop("id")
    assert labelled_sample(many, labels, "text", "doc_id", "toxic", 20).count() <= 20


def test_exact_ties_do_not_depend_on_the_layout(spark):
    rows = [(k % 3 or None, f"t{k % 5}", str(k)) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, more string")
    kept = {tuple(sorted(map(str, exact_dedup(frame.repartition(n)).collect()))) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 5
    groups = exact_groups(frame.repartition(3)).collect()
    assert sum(r.kept for r in groups) == 5 and {r.group_size for r in groups} == {12} and all(r.keep_id == 2 for r in groups)


def test_null_ids_are_spread_by_text(spark):
    docs = spark.createDataFrame([(None, f"w {k}", "s") for k in range(200)], "doc_id bigint, text string, source string")
    rows = mixed(docs, share=1.25).collect()
    assert sum(r.taken for r in rows) == 500 and all(2 <= r.taken <= 4 for r in rows)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_capacities_bind(rule):
    lengths = [900] * 5 + [400] * 40 + [10] * 300
    for capacity, least in ((Capacity(1024, 4, 1024**2), 87), (Capacity(1024, 1024, 400_000), None)):
        if least is None:
            lengths = [600] * 5 + lengths[5:]
        bins = best_fit(__import__("numpy").array(lengths), capacity, rule)
        for b in set(bins):
            held = [n for n, x in zip(lengths, bins) if x == b]
            assert sum(held) <= capacity.tokens and len(held) <= capacity.documents and sum(n * n for n in held) <= capacity.cost
        assert least is None or max(bins) + 1 >= least


def test_weights_cost_no_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    alone, every = (pack_documents(docs, weights=w).select("sequence_id").distinct().count() for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    assert every <= alone * 1.01 + 1


def test_rows_without_an_id_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS", 10)
    docs = [(k if k < 40 else None, f"text {k % 90}") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    got = spotsigs.with_next(df).collect()
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), hashes[d[1]] if d[0] is None else 0))
    want = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert sorted((str(r.id), r.text, r.next_text) for r in got) == want
    plan = spotsigs.with_next(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
