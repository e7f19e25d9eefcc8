"""Each stage of the pipeline on its own input, and the whole of it, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_op7_decontaminate import plain as leaks
from tests.llm.test_op10_jaccard_join import plain_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng, syllables):
    return "".join(rng.choice(syllables, rng.integers(2, 4)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    syll = {"aa": ["ka", "lo", "mi", "ter", "on"], "bb": ["zu", "sch", "ber", "ung", "ei"]}
    texts, langs = [], []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        texts.append("\n".join(" ".join(word(rng, syll[lang]) for _ in range(rng.integers(20, 40))) for _ in range(3)))
        langs.append(lang)
    items = [(k, " ".join(word(rng, syll["aa"]) for _ in range(20))) for k in range(5)]
    texts += ["12345 !!!", "", None, texts[0], texts[3] + " extra word", texts[5] + "\n" + items[1][1], items[2][1] + "\n" + texts[7] + " x y"]
    texts += [" ".join(w if k % 40 else "zz" for k, w in enumerate(texts[9].split("\n")[0].split() * 4))]
    langs += ["aa"] * (len(texts) - len(langs))
    out = tmp_path_factory.mktemp("sf")
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(zip(texts, langs))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_whole_run(spark, folder):
    sf, rows, items = folder
    got = cp.run(spark, sf).collect()
    ids = {r.doc_id for r in got}
    assert len(ids) == len(got) and ids <= {r[0] for r in rows}
    assert not ids & {120, 121, 122, 123, 125, 126}  # no letters, empty, null, copy, two with benchmark items
    assert set(range(120)) - {3, 5, 7} <= ids
    assert all(r.n_tokens <= r.bucket for r in got)


def test_stages_alone(spark, folder):
    sf, rows, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    assert [n for n, _ in cp.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "pack"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = cp.language(spark, docs, sf)
    assert kept.columns == docs.columns and ids(kept) == {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    some = docs.where(F.col("text").isNotNull())
    pairs = [(i, t) for i, t in text.items() if t is not None]
    assert ids(cp.near_dedup(spark, some, sf)) == {d for d, (_, c) in plain_components(pairs).items() if c == d}
    assert ids(cp.decontaminate(spark, some, sf)) == {i for i, _ in pairs} - {d for d, _ in leaks(pairs, items)}
    lines = cp.line_dedup(spark, docs, sf)
    assert lines.columns == docs.columns and 123 not in ids(lines)
    by = {r.doc_id: r for r in lines.collect()}
    assert by[125].text == items[1][1] and by[125].n_chars == len(items[1][1]) and by[1].text == text[1] and by[122].text is None
    assert cp.pack(spark, docs, sf).count() == docs.count()


def test_language_rejects_unlearned_languages_and_letter_junk(spark, folder):
    sf, rows, _ = folder
    rng = np.random.default_rng(6)
    greek = " ".join(word(rng, ["γω", "δε", "λο", "φυ"]) for _ in range(60))
    other = " ".join(word(rng, ["quy", "wix", "fjo", "gha", "vup"]) for _ in range(60))
    junk = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxzaeiouy"), rng.integers(3, 10))) for _ in range(60))
    more = [(900 + i, t, None, "s", len(t)) for i, t in enumerate((greek, other, junk))]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    kept = {r.doc_id for r in cp.language(spark, docs, sf).select("doc_id").collect()}
    assert kept == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}


def test_null_and_repeated_ids_name_one_row_each(spark, folder):
    sf, rows, items = folder
    rng = np.random.default_rng(12)
    a, b, c, d, e = (" ".join(word(rng, ["ka", "lo", "mi", "ter", "on"]) for _ in range(30)) for _ in range(5))
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in ((1, a), (1, a), (None, b), (2, b), (3, c + "\n" + d), (3, d + "\n" + e), (None, items[0][1]))], SCHEMA)
    texts = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    assert texts(cp.near_dedup(spark, docs, sf)) == sorted([(1, a), (2, b), (3, c + "\n" + d), (3, d + "\n" + e), (0, items[0][1])])
    assert texts(cp.decontaminate(spark, docs, sf)) == sorted([(1, a), (1, a), (0, b), (2, b), (3, c + "\n" + d), (3, d + "\n" + e)])
    lines = cp.line_dedup(spark, docs.where("doc_id = 3 or doc_id = 1"), sf)
    assert lines.columns == docs.columns
    assert sorted(x for r in lines.collect() for x in r.text.split("\n")) == sorted([a, c, d, e])
