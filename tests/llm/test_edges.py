"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from turnspan.llm import decontaminate, html_text, language, mixing, neardup, quality_rank, quality_rules, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, block int, node string, t string, score double"
PROSE = "The house by the river was old and it had a red door that the children of the town knew well"
LONG = " ".join(f"w{i} the of {i % 977}" for i in range(60_000))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), 7, 3, "x", "y", 0.5)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, PROSE), row(2, None), row(3, ""), row(4, " \n\t "), row(5, LONG), row(6, PROSE), row(6, PROSE), row(None, "a text without an id, in a few words of no use"), row(8, "12 34 !!"), row(9, PROSE + " again", None, None), row(10, "ÄÖÜ ßßß éé")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")


def test_mixing(docs, empty):
    got = mixing.taken(docs).collect()
    assert len(got) == docs.count()
    assert all(r["size"] == 0 for r in got if r.doc_id in (2, 3, 4)) and all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies"] and mixed.count() > 0
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, copies="text")


def test_quality_rules(docs, empty):
    got = {r.doc_id: r.quality for r in quality_rules.judge(docs).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and got[4].m.n_words == 0 and got[4].base_failed
    assert got[5].m.n_words == 240_000
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and 1 in {r.doc_id for r in kept.collect()}
    assert quality_rules.judge(empty).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>", "e"), (2, None, "<p>x</p>", "e"), (3, "http://c", None, "e"), (4, "", "", "e"), (None, "u", "<p>x</p>", "e"), (7, "u", "é" * 100_000, "e"), (7, "u", "é" * 100_000, "e")], "page_id long, url string, html string, payload string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "a"), archive_bytes=1500)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert len(got) == 7 and all(r.intact for r in got)
    assert by[2][0].type == "response" and by[1][0].refers_to == 2 and by[1][0].payload_bytes == 8 and by[None][0].refers_to == 2
    assert by[4][0].type == "response" and by[3][0].refers_to == 4 and by[3][0].payload_bytes == 0
    assert [r.type for r in by[7]] == ["response", "response"] and bytes(by[7][0].payload).decode() == "é" * 100_000
    none = spark.createDataFrame([], pages.schema)
    warc.write_archives(warc.plan_records(none), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([("a", "the children of the town knew well and more of it is here"), ("b", "Red  DOOR"), ("b", "red door"), (None, "of the town"), ("n", None), ("e", "...")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.flag(docs, bench).collect()}
    assert (got[1].dc_hit, got[1].dc_items, got[1].dc_longest) == (5, 1, 7)  # "red door" and "of the town"
    assert got[2].dc_words == 0 and got[3].dc_hit == 0 and got[5].dc_words == 240_000
    small = {r.doc_id: r for r in decontaminate.flag(docs, bench, block_words=1).collect()}  # a block for each item
    assert {i: (r.dc_hit, r.dc_items, r.dc_items_sha256) for i, r in small.items()} == {i: (r.dc_hit, r.dc_items, r.dc_items_sha256) for i, r in got.items()}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and 1 not in {r.doc_id for r in clean.collect()}
    assert decontaminate.flag(empty, bench).count() == 0
    assert decontaminate.flag(docs, bench.limit(0)).filter("dc_hit > 0").count() == 0


def test_token_counts(spark, docs, tmp_path):
    counted = token_counts.word_counts(docs.select("source", "lang", F.lit("words").alias("tokenizer"), "text"))
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("b1", token_counts.inserts(counted)) and not r.commit("b1", token_counts.inserts(counted))
    assert r.commit("b2", token_counts.inserts(counted.limit(0)))
    total = {(x.source, x.lang): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert total[None, None] == (1, 22) and total["s", "en"][0] == 10
    with pytest.raises(ValueError):
        r.commit("a/b", token_counts.inserts(counted))


def test_near_duplicates(docs, empty):
    got = {}
    for r in neardup.classes(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got[1] == got[6] == got[9] == {1} and got[2] == {2} and got[3] == {3} and got[4] == {4} and got[None] == {None}
    kept = neardup.deduplicate(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 5, 8, 10]
    assert neardup.classes(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_quality_rank(docs, empty, labels):
    m = quality_rank.fit(docs, labels)
    got = quality_rank.score(docs, m, prefix="q_").collect()
    assert len(got) == docs.count() and all(0 <= r.q_score <= 1 for r in got)
    none = quality_rank.fit(docs, labels.limit(0))
    assert {round(r.q_score, 9) for r in quality_rank.score(docs, none, prefix="q_").collect()} == {0.3}
    assert quality_rank.score(empty, m, prefix="q_").count() == 0
    with pytest.raises(ValueError):
        quality_rank.score(docs, m)  # docs has a score already


def test_toxicity(docs, empty, labels):
    m = toxicity.fit(docs, labels)
    got = toxicity.score(docs, m, prefix="x_").collect()
    assert len(got) == docs.count() and all(0 <= r.x_score <= 1 for r in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.x_score for r in toxicity.score(docs, none, prefix="x_").collect()} == {0.0}
    assert toxicity.score(empty, m, prefix="x_").count() == 0


def test_language(docs, empty):
    m = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, m, prefix="l_").collect()}
    assert got[1].l_lang_pred == "en" and all(got[i].l_lang_pred == "und" and got[i].l_rejected for i in (2, 3, 4, 8))
    none = language.fit(empty)
    assert {r.l_lang_pred for r in language.identify(docs, none, prefix="l_").collect()} == {"und"}
    assert language.identify(empty, m, prefix="l_").count() == 0


def test_html(spark):
    rows = [(1, "http://h/a", "<article><p>One two three.</p></article>", "z"), (2, None, None, "z"), (3, "odd", "", "z"), (4, "http://h/b", "no tags at all", "z"), (None, "http://h/c", "<nav>only</nav>", "z"), (6, "http://h/d", "<p>" * 5000 + "deep" + "<div>" * 3000, "z"), (6, "http://h/d", "<b>x<script>if (a<b) {", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in html_text.extract(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == ["One two three."] and got[2] == [""] and got[3] == [""] and got[4] == ["no tags at all"] and got[None] == [""]
    assert sorted(got[6]) == ["deep", "x"]
    assert html_text.extract(pages.limit(0)).count() == 0
