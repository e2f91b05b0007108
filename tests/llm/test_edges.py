"""Nulls, empty and very long texts, ties, empty tables and clashing columns, for every operator."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremorlens.llm import bpe, collocations, common, exact_dedup, langid, line_dedup, media, mixing, secrets, simhash, toxicity, warc

LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod. " * 4000
ROWS = [
    (1, "Hello there world", "en", "a", 17), (2, "hello THERE world", "en", "a", 17), (2, "hello THERE world", "en", "a", 17), (3, None, "en", None, None), (4, "", None, "b", 0),
    (5, " \t\n", "de", "b", 3), (None, "Hello there world", "de", "b", 17), (6, "É ÉÉ x", "fr", "c", 6), (7, "é éé x", "fr", "c", 6), (8, LONG, "en", "a", len(LONG)), (9, "12345 !!!", "en", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {c: F.lit("clash") for c in ("_id", "_text", "_h", "_fp", "kept", "position", "row", "slot", "score", "ids", "_source", "_salt", "lang_id", "_key")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra).repartition(3)


OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup, "line_dedup": line_dedup.line_dedup, "near_dedup": simhash.near_dedup, "bpe": bpe.encode_digests, "secrets": secrets.scan_secrets,
    "language": langid.language_id, "media": media.media_digests, "mixing": mixing.mix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_exact_dedup_ties_and_nulls(docs):
    rows = exact_dedup.exact_dedup(docs, keep="largest").collect()
    hello = [r for r in rows if r.doc_id in (1, 2, None)]
    assert {r.keep_id for r in hello} == {2} and {r.group_size for r in hello} == {4} and [r.doc_id for r in hello if r.kept] == [2]
    assert sorted((r.keep_id, r.kept) for r in rows if r.doc_id in (3, 4)) == [(4, False), (4, True)]
    assert all(r.group_size == 1 for r in rows if r.doc_id in (6, 7))  # only A-Z is lowered
    assert [r.doc_id for r in exact_dedup.exact_dedup(docs).collect() if r.keep_id == 1 and r.kept] == [1]


def test_near_dedup_of_blank_texts(docs):
    rows = {r.doc_id: r for r in simhash.near_dedup(docs).collect()}
    assert {rows[k].fingerprint for k in (3, 4, 5)} == {"0" * 16} and {rows[k].component_id for k in (3, 4, 5)} == {3}
    assert rows[None].component_id == 1


def test_line_dedup_of_empty_texts(docs):
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert (rows[3].n_lines, rows[3].kept_text) == (1, "") and rows[5].n_lines == 2 and rows[8].n_dropped == 0


def test_language_without_letters_or_labels(docs):
    rows = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert {rows[k].lang_pred for k in (3, 4, 5, 9)} == {"und"} and rows[None].held_out is False
    alone = langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_of_a_text_of_many_words(spark, docs):
    """Over 32,767 distinct words with one opening, in a labelled text."""
    wide = spark.createDataFrame([(k, " ".join(f"item{j:05d}" for j in range(40_000)) if k < 2 else f"short {k}") for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(wide, labels).collect()) == 6


def test_toxicity_of_repeated_identifiers(spark):
    docs = spark.createDataFrame([(1 + k % 2, ("idiot" if k % 2 else "nice") + f" {k % 2}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(docs, labels).collect()) == 400


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (None, None, None), (2, "http://b\r\nX: y", ""), (5000, "u", "z" * 100_000)], "page_id long, url string, html string")
    rows = warc.fixity_audit(pages, pages).collect()
    assert len(rows) == 5 and all(r.intact for r in rows)
    moved = warc.fixity_audit(pages, pages.where("page_id <> 2 or page_id is null")).collect()
    assert [r.page_id for r in moved if not r.intact] == [2]
    assert warc.fixity_audit(pages.limit(0), pages.limit(0)).collect() == []
    clash = pages.withColumns({c: F.lit("clash") for c in ("_id", "_file", "_seq", "_sha", "intact", "file")})
    assert len(warc.fixity_audit(clash, clash).collect()) == 5
    fewer = warc.fixity_audit(pages.where("page_id is null or page_id < 5000"), pages).collect()
    assert [(r.page_id, r.only_in_replica) for r in fewer if not r.intact] == [(5000, True)] and len(fewer) == 5


def test_keep_one_leaves_texts_that_only_meet_by_fingerprint(spark):
    """Short texts: one is a copy with a word changed, the other two share a fingerprint (none) but no shingle."""
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(1, text), (2, text.replace("word150", "other")), (3, " "), (4, "\n"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("clash"))
    kept = simhash.keep_one(docs, distance=10).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, None]
    assert {r._id for r in kept} == {"clash"}


def test_keep_one_drops_only_copies_of_what_stays(spark):
    """Groups of near copies with chains in them: what goes is like something smaller that stays, and nothing that stays is like another."""
    groups = [[f"w{g}x{k}" for k in range(60)] for g in range(6)]
    rows = [(1, "alone " * 9)]
    for k in range(40):
        own = list(groups[k % 6])
        for j in range(k // 6):  # later ones drift away from the first
            own[(7 * j + 3) % 60] = f"other{j}"
        rows.append((k + 2, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    text = dict(rows)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    for k in set(text) - kept:
        assert any(j < k and simhash.overlap(text[k], text[j]) >= 0.5 for j in kept)
    assert not [(a, b) for a in kept for b in kept if a < b and simhash.overlap(text[a], text[b]) >= 0.8]


def test_unlike_document_saves_no_copy(spark, monkeypatch):
    """B and C are alike; A, proposed to both, is like neither. C goes as it would without A."""
    near = " ".join(f"w{k}" for k in range(80))
    rows = [(1, " ".join(f"a{k}" for k in range(80))), (2, near), (3, near.replace("w40", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = simhash._proposed
    extra = lambda rest, *a: proposed(rest, *a).unionByName(rest.where("_id > 1").select(F.col("_id").alias("_a"), F.lit(1).cast("long").alias("_b"))).distinct()
    monkeypatch.setattr(simhash, "_proposed", extra)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2]


def test_every_leader_of_a_full_bucket_is_compared(monkeypatch):
    """Of 40 rows of one bucket that holds 8 leaders at once, the last two are alike and nothing else is."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    bits = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, (40, simhash.SKETCH // 64))
    bits[39] = bits[38]
    names = [f.split()[0] for f in simhash.FOUND.split(", ")]
    links, rows = [], [np.full(40, 5), np.full(40, 7), np.arange(40), np.zeros(40, np.int64), *bits.T]
    for whole in (False, *[True] * 40):
        if not len(rows[0]):
            break
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)
        got = [np.stack([c.to_numpy() for c in b.columns]) for b in simhash.scan_sketches(iter([batch]), 0.5, whole=whole)]
        got = np.concatenate(got, axis=1) if got else np.zeros((len(names), 0), np.int64)
        links += got[2:4, got[0] == 0].T.tolist()
        rows = list(got[:, got[0] != 0])
        assert set(rows[0]) <= {5} and set(rows[1]) <= {7}
        order = np.argsort(rows[2])
        rows = [r[order] for r in rows]
    assert [39, 38] in links and all(pair == [39, 38] for pair in links) and not len(rows[0])


def test_all_that_a_document_may_be_like_are_compared_by_text(spark):
    """The nearest by sketch is unlike by text, a farther one is alike."""
    sketch = lambda n: [(1 << n) - 1, 0, 0, 0]
    words = [f"w{k}" for k in range(60)]
    text = {1: "other " * 40, 2: " ".join(words), 3: " ".join(words).replace("w30", "x")}
    nodes = spark.createDataFrame([(1, sketch(50)), (2, sketch(55)), (3, sketch(0))], "_id long, _sk array<long>")
    pairs = spark.createDataFrame([(3, 1), (3, 2)], "_a long, _b long")
    got = simhash._linked(pairs, nodes, spark.createDataFrame(list(text.items()), "_id long, _text string"), 0.5)
    assert [tuple(r) for r in got.collect()] == [(3, 2)]


@pytest.mark.parametrize("most", [16, 1])
def test_chain_of_near_copies_takes_few_rounds(spark, monkeypatch, most):
    """Each text is like the next three. All links are found in one round, where a document isn't held to one link a round."""
    monkeypatch.setattr(simhash, "LINKS", most)
    monkeypatch.setattr(simhash, "MORE", 2)
    text = {k: " ".join(f"w{j}" for j in range(10 * k, 10 * k + 100)) for k in range(1, 31)}
    want = []
    for k in text:
        if not any(simhash.overlap(text[j], text[k]) >= 0.5 for j in want):
            want.append(k)
    rounds, proposed = [], simhash._proposed
    monkeypatch.setattr(simhash, "_proposed", lambda *a: rounds.append(1) or proposed(*a))
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(docs, distance=20).collect()) == want and len(want) == 8
    assert most == 1 or len(rounds) == 1


def test_large_group_hands_on_few_rows():
    """Of 1,000 like sketches in a bucket the first `most` go on to another scan; each of the others has as many links and a mark."""
    rows = [np.full(1000, 5), np.full(1000, 7), np.arange(1000), np.zeros(1000, np.int64), *np.zeros((simhash.SKETCH // 64, 1000), np.int64)]
    names = [f.split()[0] for f in simhash.FOUND.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)
    got = np.concatenate([np.stack([c.to_numpy() for c in b.columns]) for b in simhash.scan_sketches(iter([batch]), 0.5, False, 4)], axis=1)
    links, marks, on = (got[2:4, (got[0] == m) & (got[1] == k)] for m, k in ((0, 0), (0, 1), (5, 7)))
    assert on[0].tolist() == [0, 1, 2, 3] and marks[0].tolist() == list(range(4, 1000))
    assert links.T.tolist() == [[a, b] for a in range(1000) for b in range(min(a, 4))]


def test_near_copies_are_compared_with_what_stays(spark, monkeypatch):
    """Of 120 near copies each is compared with the first, not with 16 of one another, and the texts aren't shuffled for that."""
    words = [f"w{j}" for j in range(100)]
    text = {k: " ".join([*words[:-1], f"last{k}"]) for k in range(1, 121)}
    compared, linked = [], simhash._linked
    monkeypatch.setattr(simhash, "_linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    got = simhash.keep_one(spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3))
    assert [r.doc_id for r in got.collect()] == [1] and sum(compared) <= 2 * len(text)


def test_scan_without_drop_links_those_that_ask():
    """A row with as many links as it gets is marked, and still compared with what comes after it."""
    bits = np.zeros((5, simhash.SKETCH // 64), np.int64)
    bits[4] = -1
    bits[4, 3] = 0
    bits[3, :2] = -1  # like the last one and none of the others
    names = [f.split()[0] for f in simhash.FOUND.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(5, 5), np.full(5, 7), np.arange(5), np.array([1, 1, 0, 1, 1]), *bits.T)], names)
    got = np.concatenate([np.stack([c.to_numpy() for c in b.columns]) for b in simhash.scan_sketches(iter([batch]), 0.5, True, 1, drop=False)], axis=1)
    assert got[2:4, (got[0] == 0) & (got[1] == 0)].T.tolist() == [[1, 0], [4, 3]] and sorted(got[2, (got[0] == 0) & (got[1] == 1)]) == [1, 4]


def test_materialize_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before, setting = held(), spark.conf.get(common.CLEANUP)
    rows = common.materialize(spark.range(1000).repartition(3, "id"), "shuffled")
    deadline = time.time() + 20
    while held() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not held() - before and rows.count() == 1000 and spark.conf.get(common.CLEANUP) == setting


def test_collocations_drop_what_is_counted(spark, monkeypatch):
    """Words and packs of pairs are off the disk before the next pairs are shuffled and written."""
    folder, beside, materialize = common.shared_dir(spark).removeprefix("file://"), [], collocations.materialize

    def noted(df, name, *a):
        if name == "pairs":
            beside.append({x for x in os.listdir(folder) if x.startswith(("words-", "pairs-"))} - before)
        return materialize(df, name, *a)

    before = set(os.listdir(folder))
    monkeypatch.setattr(collocations, "materialize", noted)
    docs = spark.createDataFrame([("a b c d. a b c d", "en")] * 40, "text string, lang string")
    found, _ = collocations.phrases(docs)
    assert {(r.phrase, r.a) for r in found.where("k = 4").collect()} == {("a b c d", 80)} and beside == [set()] * 3


def test_documents_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """40 texts that share a passage, too little to be copies and too much for sketches to tell: none is a row with another."""
    passage = [f"p{j}" for j in range(60)]
    text = {k: " ".join([*passage, *(f"own{k}x{j}" for j in range(40))]) for k in range(1, 41)}
    compared, linked = [], simhash._linked
    monkeypatch.setattr(simhash, "_linked", lambda pairs, *a: compared.append(pairs.count()) or linked(pairs, *a))
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    assert simhash.keep_one(docs, distance=20).count() == 40 and sum(compared) <= len(text)


def test_sets_and_first_buckets_equal_plain_ones():
    """Similarities in a bucket against those of texts (hashes above 2**63 among them), and pairs against a search for their first bucket."""
    words = [f"w{j}" for j in range(40)]
    texts = [" ".join(words[: 40 - k] + [f"x{k}{j}" for j in range(k)]) for k in range(20)] + [" "]
    sets = [simhash.shingle_hashes(t) for t in texts]
    a, c = np.nonzero(np.tril(np.ones((21, 21), bool), -1))
    want = [simhash.overlap(texts[x], texts[y]) >= 0.5 for x, y in zip(a, c)]
    assert simhash._shared(sets, a, c, 0.5).tolist() == want and 0 < sum(want) < len(want)
    holds = simhash._confirmed(sets, a, c, np.full(len(a), 80), 0.5, 2)
    firsts = [[y for x, y, w in zip(a, c, want) if w and x == k][:2] for k in range(21)]
    assert [c[holds & (a == k)].tolist()[:2] for k in range(21)] == firsts
    fps = np.random.default_rng(5).integers(-2, 2, (30, 2))
    of, seen = [1 << 63 | 1, 2, 3], []
    buckets = [{(simhash._signed(m), int(f) & simhash._signed(m)) for m in of for f in row} for row in fps]
    for m, k in sorted(set().union(*buckets)):
        pairs = [(x, y) for x in range(30) for y in range(x) if (m, k) in buckets[x] & buckets[y]]
        x, y = np.array(pairs).reshape(-1, 2).T
        first = simhash._first_met(fps[x], fps[y], np.full(len(x), m), np.full(len(x), k), of)
        assert [pairs[i] for i in first] == [(i, j) for i, j in pairs if min(buckets[i] & buckets[j]) == (m, k)]
        seen += [pairs[i] for i in first]
    assert sorted(seen) == sorted((x, y) for x in range(30) for y in range(x) if buckets[x] & buckets[y])


def test_keep_one_of_empty_and_single_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 1 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_pipeline_stages_keep_columns(spark, docs, clashing):
    at = docs if clashing else spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, at, "")
        assert name == "bpe" or got.columns == at.columns
        at = corpus_pipeline.materialize(got, name) if name != "bpe" else got
        if clashing and name != "bpe":
            assert {v for r in at.collect() for c, v in r.asDict().items() if c not in SCHEMA} == {"clash"}
    assert sorted(r.doc_id for r in at.collect()) == [2, 6, 7, 8]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
