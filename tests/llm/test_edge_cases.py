"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tintworks.llm import license_scan, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, sentencepieces, sharding, transport_streams, url_filters

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over the lazy dog and runs to the river with all of its friends in the early morning light"


def rows():
    long = " ".join(f"word{i % 997} and the {i}" for i in range(30_000))
    return [
        (1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", len(PROSE)), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "xx", "", 4),
        (None, PROSE + " once more", "de", "b", 10), (None, None, None, None, None), (6, long, "en", "c", len(long)), (7, "x" * 300_000, None, "c", 300_000), (8, "é 日本語 😀\x00   |", "fr", "d", 12),
        (9, "one", "es", "d", 3), (2, "another text under the same id " + PROSE[::-1], "en", None, 1),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (6, 0, None), (None, 1, 1), (9, None, 0), (8, 5, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def model():
    return sentencepieces.PieceModel.load(sentencepieces.default_model_path())


SMALL = quality_classifier.ClassifierConfig(bits=10, epochs=1, min_steps=2)
OPERATORS = {
    "classifier": lambda d, labels, model: quality_classifier.classify(d, labels, SMALL),
    "mixing": lambda d, labels, model: mixing.mix(d),
    "sharding": lambda d, labels, model: sharding.assign_shards(d, 5, prime=101),
    "lines": lambda d, labels, model: line_dedup.dedup_lines(d),
    "near": lambda d, labels, model: minhash_dedup.near_duplicates(d),
    "licenses": lambda d, labels, model: license_scan.scan_licenses(d),
    "pieces": lambda d, labels, model: sentencepieces.encode_pieces(d, model),
    "rules": lambda d, labels, model: quality_rules.quality_rules(d),
    "media": lambda d, labels, model: transport_streams.store_media(d).withColumn("r", transport_streams.read_media(F.col("media"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(name, docs, labels, model):
    out = OPERATORS[name](docs, labels, model).collect()
    assert len(out) == len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, labels, model):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), model).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(name, docs, labels, model):
    extra = {c: F.lit("mine") for c in ("f", "k", "held", "score", "size", "target", "slot", "shard", "row_key", "places", "n", "h1", "keys", "node", "comp", "license", "coverage", "media", "piece_ids", "encoded", "quality", "kept", "scanned", "table_slot", "mix_source")}
    few = docs.where("doc_id in (1, 2, 9)").withColumns(extra)
    assert OPERATORS[name](few, labels, model).count() == few.count()


def test_defined_results(docs, labels, model):
    mixed = {(r["doc_id"], r["text"] is None): r for r in mixing.mix(docs).collect()}
    assert mixed[3, True]["size"] == 0 and mixed[3, True]["taken"] == 0
    near = minhash_dedup.near_duplicates(docs).collect()
    by_id = lambda i: [r for r in near if r["doc_id"] == i]
    assert {(r["component_id"], r["kept"]) for r in by_id(3) + by_id(4) + by_id(5)} == {(3, True), (4, True), (5, True)}
    assert sorted((r["component_id"], r["kept"]) for r in by_id(2)) == [(1, False), (1, False), (2, True)]
    assert sorted((r["component_id"] is None, r["n_shingles"] > 0, r["kept"]) for r in by_id(None)) == [(False, True, False), (True, False, True)]
    kept = minhash_dedup.drop_near_duplicates(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "9", "None"])
    rules = {r["doc_id"]: r["quality"] for r in quality_rules.quality_rules(docs).collect() if r["doc_id"] in (3, 4, 5, 7)}
    assert all(q["base_failed"] and not q["kept"] and q["n_words"] == (1 if i == 7 else 0) for i, q in rules.items())
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).where("doc_id in (1, 3, 4)").collect()}
    assert lines[3]["text"] is None and lines[4]["text"] == "" and lines[1]["text"] == PROSE
    pieces = [r for r in sentencepieces.encode_pieces(docs, model).collect()]
    assert all(r["round_trip"] for r in pieces) and all(r["n_pieces"] == 0 for r in pieces if not r["text"])
    shards = sharding.assign_shards(docs, 5, prime=101).groupBy("doc_id").agg(F.countDistinct("shard").alias("n"))
    assert shards.where("n <> 1").count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme.com/en/"), (4, "http://WWW.Example.com/en/x?y#z"), (5, "://"), (None, "http://a.net/es/"), (7, "ftp://x.co.uk?q=/a"), (7, "ftp://x.co.uk?q=/a")], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 0), (None, 0), (4, None)], "doc_id bigint, quality int")
    rules = [url_filters.Rule("allow", "com/"), url_filters.Rule("block", "example.com/en/"), url_filters.Rule("allow", "www.example.com/en/"), url_filters.Rule("block", "net/es/")]
    pages = pages.withColumns({c: F.lit(1) for c in ("label_key", "host_key", "verdict")})
    out = {(r["page_id"], r["url"]): r for r in url_filters.filter_urls(pages, labels, rules).collect()}
    assert len(out) == 7
    assert all(out[k]["host"] == "" and out[k]["path"] == "" and out[k]["rule"] is None for k in ((1, None), (2, ""), (3, "no scheme.com/en/"), (5, "://")))
    top = out[4, "http://WWW.Example.com/en/x?y#z"]
    assert (top["host"], top["path"], top["rule"], top["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert out[None, "http://a.net/es/"]["verdict"] == "block" and out[7, "ftp://x.co.uk?q=/a"]["path"] == ""
    assert url_filters.filter_urls(pages.limit(0), labels.limit(0), rules).count() == 0


@pytest.mark.parametrize("position", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, position):
    name, stage = corpus_pipeline.STAGES[position]
    last = position == len(corpus_pipeline.STAGES) - 1
    for given in (docs, docs.limit(0), docs.withColumns({"quality": F.lit(1), "copy": F.lit("x"), "taken": F.lit(0)})):
        out = stage(spark, given, "/nowhere")
        assert out.count() <= 2 * given.count()
        if not last:
            assert out.columns == list(corpus_pipeline.DOCUMENT_COLUMNS)
