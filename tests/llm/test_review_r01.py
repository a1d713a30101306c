"""Cases of the second review: each failed before its finding was settled."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_edge_cases import OPERATORS, docs, labels, model  # noqa: F401
from test_operators import components

from tintworks.llm import line_dedup, links, minhash_dedup, sentencepieces, transport_streams, url_filters


def thue_morse(letters):
    word = letters[0]
    while len(word) < 1024:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_words_that_polynomial_hashes_confuse(spark):
    texts = spark.createDataFrame([(1, thue_morse("ab") + " end"), (2, thue_morse("ba") + " end")], "doc_id bigint, text string")
    near = minhash_dedup.near_duplicates(texts, minhash_dedup.NearDupConfig(width=2)).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in near)
    lines = spark.createDataFrame([(1, thue_morse("ab")), (2, thue_morse("ba"))], "doc_id bigint, text string")
    apart = {r["doc_id"]: r["h1"] for r in lines.select("doc_id", F.explode(line_dedup._coded_lines(F.col("text"), line_dedup.LineConfig())["h1"]).alias("h1")).collect()}
    assert apart[1] != apart[2]


@pytest.mark.parametrize("many", (0, 16, 1_000))
def test_links_in_stars_of_any_size(spark, many, monkeypatch):
    """The same links whether a star's elements are counted or told in a fixed order."""
    monkeypatch.setattr(links, "MANY", many)
    rng = random.Random(many)
    base = [[f"{g}w{i}" for i in range(60)] for g in range(3)]
    texts = {}
    for i in range(120):
        words = list(base[i % 3]) if i % 4 else base[i % 3] + base[(i + 1) % 3][: rng.randrange(12)]
        for _ in range(rng.randint(1, 11)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(15)}"
        texts[i] = " ".join(words)
    sets = {i: frozenset(zip(w, w[1:])) for i, w in ((i, t.split()) for i, t in texts.items())}
    out = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), minhash_dedup.NearDupConfig(width=2))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == components(sets, 80)


CLASHING = ("epochs", "cut", "edge", "Scanned", "Encoded", "Score", "Quality", "a.b", "given", "s", "h", "k", "gone", "Row_Key", "node")


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "near"])
def test_given_columns_keep_their_values(name, docs, labels, model):  # noqa: F811
    few = docs.where("doc_id in (1, 2, 9)").withColumns({c: F.lit(f"mine {c}") for c in CLASHING})
    out = OPERATORS[name](few, labels, model).collect()
    assert len(out) == few.count()
    replaced = {"classifier": ("Score",), "rules": ("Quality",)}.get(name, ())
    assert all(r[c] == f"mine {c}" for r in out for c in CLASHING if c not in replaced)


def test_one_row_of_a_group_of_one_id(spark):
    """Rows of one id, or of none, with near but different texts: one stays."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:k] + [f"x{k}"] + words[k + 1 :])) for i in (7, None) for k in (0, 59)]
    for some in (rows[:2], rows[2:]):
        assert minhash_dedup.drop_near_duplicates(spark.createDataFrame(some, "doc_id bigint, text string")).count() == 1


def test_runs_of_spaces_are_encoded_soon(model):  # noqa: F811
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model_path())
    for text in (" " * 20_000, " " * 20_001 + "end", "a" + " " * 5_000 + "b"):
        encoder, began = sentencepieces.Encoder(model), time.perf_counter()
        assert encoder.encode(text) == library.encode(text)
        assert time.perf_counter() - began < 5
        assert encoder.decode(encoder.encode(text)) == text


def test_full_caches_change_nothing(model, monkeypatch):  # noqa: F811
    texts = [f"word{i} und {i * 7919} naïve 日本" for i in range(300)]
    want = [sentencepieces.Encoder(model).encode(t) for t in texts]
    for name in ("WORD_CACHE", "PIECE_CACHE", "STAY_CACHE"):
        monkeypatch.setattr(sentencepieces, name, 20)
    encoder = sentencepieces.Encoder(model)
    assert [encoder.encode(t) for t in texts] == want


def test_damaged_times_are_reported():
    for size in range(9, 14):
        unit = (b"\x00\x00\x01\xbd\x00\x00\x80\x80\x05" + b"\xff" * 10)[:size]
        stream = bytearray(transport_streams.mux(transport_streams.pad(b"text")))
        at = 188 * (len(stream) // 188 - 1)
        body = 188 - 4 - size
        stream[at : at + 188] = stream[at : at + 3] + bytes([stream[at + 3] & 0x0F | 0x30, body - 1, 0]) + b"\xff" * (body - 2) + unit
        assert any("times" in e for e in transport_streams.demux(bytes(stream)).errors)


def test_reputation_blocks_and_spares(spark):
    hosts = {"bad.example.org": 0, "good.example.org": 1, "bad.site.net": 0, "good.site.net": 1}
    rows = [(n * 100 + i, f"http://{host}/p/{i}", q) for n, (host, q) in enumerate(hosts.items()) for i in range(40)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(9_000, "http://new.host.info/")], "page_id bigint, url string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 100 < 30], "doc_id bigint, quality int")
    out = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, known, []).collect()}
    assert all(out[i] == ("allow" if q else "block") for i, _, q in rows) and out[9_000] == "allow"
