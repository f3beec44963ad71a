"""Edges of operators that earlier fixtures left out: odd identifiers, missing labels, clashing names, names in pages."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from segno.llm import decontaminate, html_extract, langid

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOC)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_without_and_with_text_identifiers_equal_the_sql(spark, kind, monkeypatch):
    items = [(None, "beta gamma"), (None, "delta"), (7, "alpha beta"), (12, "alpha beta"), (7, "epsilon zeta"), (3, None), (4, "...")]
    if kind == "string":
        items = [(None if i is None else f"item-{i}", t) for i, t in items]
    texts = [(1, "alpha beta gamma delta", None), (2, "nothing here", None), (2, "epsilon zeta", None), (None, "delta delta", None), (5, None, None), (6, "x " * 30 + "delta", None)]
    documents = docs_of(spark, texts).withColumn("items", F.lit("x")).withColumn("item_id", F.lit("x")).withColumn("row", F.lit(1))
    benchmark = spark.createDataFrame(items, f"item_id {kind}, text string").withColumn("doc_id", F.lit(1))
    con = duckdb.connect()
    con.register("documents", documents.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.execute(f"CREATE TABLE benchmark (item_id {'BIGINT' if kind == 'long' else 'VARCHAR'}, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    # Its joins are by doc_id; here identifiers repeat and are missing, so texts stand for them.
    con.execute("CREATE TABLE keyed AS SELECT row_number() OVER () AS doc_id, text, doc_id AS own FROM documents")
    want = con.execute(f"SELECT own, x.* EXCLUDE (doc_id) FROM ({decontaminate.SQL.replace('FROM documents', 'FROM keyed')}) x JOIN keyed USING (doc_id)").fetchall()
    for limit in (decontaminate.QUERY_BYTES, 8):  # at once, and in parts
        monkeypatch.setattr(decontaminate, "QUERY_BYTES", limit)
        got = [tuple(r) for r in decontaminate.contamination_digest(documents, benchmark).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    row = next(g for g in got if g[0] == 1)
    names = ["12", "7"] if kind == "long" else ["item-12", "item-7"]
    assert row[2:5] == (4, 3, hashlib.sha256(",".join(names).encode()).hexdigest()) and row[5]


ENGLISH = "the river and the sea were quiet that morning while birds crossed the stone bridge near town "
GERMAN = "der Fluss und das Meer waren ruhig an diesem Morgen und Vögel flogen über die steinerne Brücke "


def test_the_language_stage_keeps_documents_where_nothing_has_a_label(spark):
    rows = [(k, f"{ENGLISH} {k}", None) for k in range(20)] + [(90, None, None), (91, "", None), (92, "12 34", None), (None, ENGLISH, None)]
    kept = langid.drop_unknown_language(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == list(range(20)) and kept.count() == 21


def test_the_language_stage_rejects_what_is_in_no_language(spark):
    rows = [(k, f"{ENGLISH} {k}", "en") for k in range(30)] + [(100 + k, f"{GERMAN} {k}", "de") for k in range(30)]
    junk = "qxzj wvkq jjxq zzkw qqvx xkcd wqzx vvzq kkxj zqxw"
    rows += [(200, junk, None), (201, "ok", None), (202, ENGLISH, None), (202, ENGLISH, None), (203, "Зима", None), (None, GERMAN, None)]
    df = docs_of(spark, rows)
    for c in ("known", "lang_pred", "score", "label"):
        df = df.withColumn(c, F.lit("x"))
    kept = langid.drop_unknown_language(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 200 not in ids and ids.count(202) == 2 and {201, 203, None} <= set(ids) and len(ids) == len(rows) - 1 and kept.columns == df.columns


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p class="share-price">A b.</p><div id="search-results">C</div><p class="ad-free">D</p><p class="menu-item-story">E</p></article>', "A b. C D E"),
        ('<article><div class="lead header-image">F</div><p class="post-comments-policy">G</p></article>', "F G"),
        ('<main><article>Story</article><div class="comment-body"><article>bad</article></div><section id="user-comments"><article>bad</article></section></main>', "Story"),
        ('<article>Story</article><div class="comment-body"><article>bad</article></div>', "Story"),
        ('<article>Story<div class="comment-list"><article>bad</article></div></article>', "Story"),
        ('<article>Story</article><article class="related-post">bad</article>', "Story"),
        ('<article>Story<div class="share">bad</div><nav>bad</nav></article>', "Story"),
        ('<article class="post has-sidebar">Story</article>', "Story"),
    ],
)
def test_names_in_pages(page, text):
    assert html_extract.main_text(page) == text


def test_a_sentence_that_articles_share_stays(spark):
    page = lambda k: f"<html><body><nav>Home</nav><article><p>Case {k} was told.</p><p>The court found the defendant guilty.</p><p>Read more</p></article></body></html>"
    rows = [(k, "http://host/x", page(k)) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Case {k} was told. The court found the defendant guilty." for k in range(6))


def test_the_pipeline_on_odd_and_on_empty_documents(spark, tmp_path):
    import corpus_pipeline

    same = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, same, None), (1, same, None), (2, same, None), (2, same, None), (None, "words that no other document has at all", None), (5, None, None), (6, " ...", None), (7, "", None)]
    rows += [(8, "item words that a benchmark holds too", None), (9, f"{GERMAN} {GERMAN}", None), (9, "another text of the same identifier", None)]
    for name, held in (("odd", rows), ("empty", [])):
        df = docs_of(spark, held)
        for c in ("row", "hash", "_bad_hash", "_bad_doc_id", "fp", "known", "_row", "_id", "component"):
            df = df.withColumn(c, F.lit("x"))
        df.coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        items = spark.createDataFrame([(None, "item words that a benchmark holds too")], "item_id long, text string")
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 2), (False, 9), (False, 9), (True, 0)]
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
