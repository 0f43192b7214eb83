"""Cases that a cut in an operator would lose."""

import numpy as np
import pytest

from turnspan.llm import html_text, toxicity, warc


def test_copy_of_a_toxic_example_with_rare_words(spark):
    texts = [(i, f"plain{i} words{i} of{i % 7} the day{i % 5}") for i in range(40)] + [(100, "zyxgrob quuxly vrantik"), (200, "zyxgrob quuxly vrantik"), (201, "zyxgrob quuxly vrantik unseen")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got[200].evidence[0].example == "100" and got[200].evidence[0].toxic == 1 and got[200].evidence[0].cosine == pytest.approx(1, abs=1e-6)
    assert got[201].evidence[0].cosine < 0.999  # the unseen word counts in the norm
    assert got[200].score > max(got[i].score for i in range(40))


@pytest.mark.parametrize("dense", [0, 7, 1024])
def test_searches_equal_brute_force(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rng = np.random.default_rng(5)
    n, terms = 1500, 90
    x = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0)
    x[700:800] = x[3]  # many equal ones
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    e, t = np.nonzero(x)
    index = toxicity.BlockMaxIndex.build(list(range(n)), np.zeros(n), e, t, x[e, t])
    q = np.concatenate([x[:200], np.zeros((1, terms))])
    r, t = np.nonzero(q)
    for row, (e, c) in zip(q, index.top_many(np.searchsorted(r, np.arange(len(q) + 1)), t, q[r, t], 15)):
        cosine = x @ row
        want = np.sort(cosine[cosine > 0])[::-1][:15]
        assert np.allclose(c, want, atol=1e-6) and np.allclose(cosine[e], want, atol=1e-6)


@pytest.mark.parametrize("shapes", [50_000, 0])
def test_templates_of_a_host_beyond_the_eighth(spark, monkeypatch, shapes):
    monkeypatch.setattr(html_text, "BROADCAST_SHAPES", shapes)
    page = '<div class="t{k}"><p>The article of template {k}, in some words.</p></div><div class="x{k}"><p>{more}</p></div>'
    rows = []
    for n, k in enumerate("abcdefghijkl"):  # the later the template, the fewer pages
        rows += [(100 * n + i, f"http://h.example/{n}/{i}", page.format(k=k, more="Side.")) for i in range(14 - n)]
        rows.append((100 * n + 99, f"http://h.example/{n}/99", page.format(k=k, more="A long comment that is not named as one, longer than the article. " * 5)))
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for n, k in enumerate("abcdefghijkl"):
        assert got[100 * n + 99].text == f"The article of template {k}, in some words.", k


def test_archives_larger_than_a_binary_file_may_be(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 50)) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "some archives")
    warc.write_archives(warc.plan_records(pages), path)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # Spark's own limit is 2 GB
    try:
        got = warc.read_archives(spark, path, run_bytes=700).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted(r.id for r in got) == list(range(300)) and all(r.intact for r in got)
    assert all(r.type == "revisit" or bytes(r.payload).decode() == f"<p>page {r.id}</p>" * (r.id % 50) for r in got)


def test_an_index_is_read_in_parts(monkeypatch):
    monkeypatch.setattr(warc, "INDEX_BYTES", 37)
    records = [(i, "é", warc.write_record(i, "é", b"x" * i, warc.digest_of(b"x" * i), None)) for i in range(40)]
    assert [r["payload"] for *_, r in warc.read_archive(warc.BytesRanges(warc.pack(records)))] == [b"x" * i for i in range(40)]
