"""Cases of the review of round 1: each failed before its finding was settled."""

import collections
import random
import re

from test_operators import components, lower

from tintworks.llm import license_scan, line_dedup, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines_left(documents):
    """What stays of each document by comparing all pairs of lines with a word."""
    places = collections.defaultdict(list)
    for d, text in documents:
        for place, line in enumerate(text.split("\n")):
            if words := WORD.findall(lower(line)):
                places[" ".join(words)].append((d, place))
    sets = {f: frozenset(f[i : i + 8] for i in range(max(1, len(f) - 7))) for f in places}
    groups = collections.defaultdict(list)
    for form, root in components(sets, 80).items():
        groups[root] += places[form]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {d: "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone) for d, text in documents}


def test_short_lines_are_compared(spark):
    han = "敏捷的棕色狐狸跳过懒狗然后跑到河边去和朋友们一起玩耍直到太阳落山"
    texts = ["les.\nAnd  ornd.", "LES.\n\n \nle treque.\nles", "and ornd.\n" + han, han + "。\nle treque.", "--------\nabababab", "-----------\n----------", "cababababa\ncabababababa", "babababab\nababababa"]
    docs = list(enumerate(texts))
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == lines_left(docs)


def test_all_lines_by_brute_force(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = line_dedup.dedup_lines(given).collect()
    assert {r["doc_id"]: r["text"] for r in out} == lines_left([tuple(r) for r in given.collect()])


def test_junk_that_only_the_word_distance_tells(spark):
    """Words in the order of prose, with its character classes, but hardly a common word."""
    rng = random.Random(5)
    rare = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rare = [w for w in rare if w not in quality_rules.WORDS]
    common = quality_rules.COMMON_WORDS["en"]
    text = lambda share, n: " ".join(rng.choice(common) if rng.random() < share else rng.choice(rare) for _ in range(n))
    prose, junk = [text(0.45, rng.randint(150, 400)) for _ in range(150)], [text(0.1, rng.randint(150, 400)) for _ in range(8)]
    copied = prose + junk + prose[:1] * 400
    rows = [(i, t, "en") for i, t in enumerate(copied)]
    out = {r["doc_id"]: r["quality"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    junk_ids = range(len(prose), len(prose) + len(junk))
    assert all(not out[i]["base_failed"] and out[i]["class_distance"] < 0.33 and out[i]["word_distance"] < 0.47 and not out[i]["kept"] for i in junk_ids)
    # copies of one text don't narrow the spread of the others
    assert sum(out[i]["kept"] for i in range(len(prose))) >= 0.97 * len(prose)


def test_adjacent_notices():
    config = license_scan.LicenseConfig()
    templates = license_scan.compiled(config)
    for t in templates:
        notice = config.templates[t.name]
        for copies, between in ((2, " "), (3, " "), (2, " and also here ")):
            text = "Some words before foo. " + between.join([notice] * copies) + " bar and others after it."
            name, share, first, last = license_scan.scan(text.encode(), templates, config)
            assert (name, share, first, last) == (t.name, 1.0, 4, 3 + len(t.words))
    notice = config.templates["mit-notice"].replace("free of charge", "gratis").replace("sublicense", "relicense")
    assert license_scan.scan(f"foo {notice} {notice} bar".encode(), templates, config)[0] == "mit-notice"
