"""Each operator against plain Python or its SQL."""

import base64
import gzip
import os
import random
from collections import Counter, defaultdict
from hashlib import sha256
from urllib.parse import quote

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tremorlens.llm import bpe, common, exact_dedup, langid, line_dedup, media, mixing, secrets, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in common.documents(spark, SF).collect()}


@pytest.mark.parametrize(("query", "sql"), [(exact_dedup.op1_exact_dedup, exact_dedup.OP1_SQL), (line_dedup.op4_line_dedup, line_dedup.OP4_SQL), (warc.op9_warc_audit, warc.OP9_SQL)])
def test_equals_sql(query, sql, same):
    assert same(query, sql) > 0


def test_salted_groups_equal_plain_ones(spark, monkeypatch):
    """Small limits, so that the large group is salted and merged again."""
    rows = [(k, "Copy of one text, long enough to be a line that counts" if k % 3 else f"own text {k} and a few words more to pass the least length") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for op, key in ((exact_dedup, lambda d: exact_dedup.exact_dedup(d, keep="largest")), (line_dedup, line_dedup.line_dedup)):
        monkeypatch.setattr(op, "heavy_keys", lambda *a: None)
        want = sorted(map(str, key(docs).collect()))
        monkeypatch.setattr(op, "heavy_keys", common.heavy_keys)
        assert common.heavy_keys(docs.select(F.xxhash64("text").alias("h")), "h", 600) is not None
        assert sorted(map(str, key(docs).collect())) == want


def fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_fingerprints_and_components(spark, texts):
    fps = {k: fingerprint(t) for k, t in texts.items()}
    want = linked(fps, 3)
    got = simhash.op2_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_links_of_dense_fingerprints(spark, monkeypatch, distance):
    """Families around few centres, with buckets so small that they overflow and are dealt anew."""
    monkeypatch.setattr(simhash, "BUCKET", 2048)
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {k: centres[k % 4] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for k in range(400)}
    groups = spark.createDataFrame([(simhash._signed(f), k) for f, k in {f: k for k, f in fps.items()}.items()], "_fp long, _rep long")
    roots = {r._node: r._root for r in simhash.components(simhash.links(groups, distance)).collect()}
    want, by = linked(fps, distance), defaultdict(set)
    for k, f in fps.items():
        by[want[k]].add(f)
    for members in by.values():
        assert len({roots.get(simhash._signed(f), simhash._signed(f)) for f in members}) == 1
    assert len({roots.get(simhash._signed(f), simhash._signed(f)) for f in fps.values()}) == len(by)


def test_large_buckets_are_dealt_anew():
    import pyarrow as pa

    n = 5000
    fps = np.arange(n, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), -(1 << 40))), pa.array(np.zeros(len(x), np.int64)), pa.array(x)], ["_m", "_k", "_fp"]) for x in np.array_split(fps, 7)]
    out = [np.stack([c.to_numpy() for c in b.columns]) for b in simhash.scan_buckets(iter(batches), 3)]
    rows = np.concatenate(out, axis=1)
    assert rows.shape[1] == 4 * n and (rows[0] != 0).all() and all(Counter(rows[0].tolist())[m] == n for m in set(rows[0].tolist()))


def test_threshold_sum_covers_every_pair():
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    for n in (100, 10**6, 10**9):
        parts = simhash.plan_parts(n, both * n / 1000, 3)
        m = len(parts)
        assert sum(t for _, t in parts) + 0 >= 3 - m + 1 and len({b for bits, _ in parts for b in bits}) == sum(len(b) for b, _ in parts)


def test_bpe_equals_library(texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    odd = ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 3000, " " * 500 + "a", "don't WE'LL 's", "日本語 한국어 \u0085  x", "👩‍👩‍👧"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(100)) for _ in range(100)]
    coder = bpe.Coder(bpe.MergeAutomaton(bpe.tokenizer_file()))
    every = [*odd, *texts.values()]
    for text, (n, ids_sha, text_sha, ids) in zip(every, coder.coded(every, with_ids=True)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and n == len(want) and ids_sha == sha256(",".join(map(str, want)).encode()).hexdigest()
        assert text_sha == sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_bpe_table_equals_gadgets_by_sets(seed, tmp_path):
    """The table against the construction written with sets, state by state, for random merges."""
    import json

    rng = random.Random(seed)
    letters = "abc"
    vocab, merges = {c: k for k, c in enumerate(letters)}, []
    while len(merges) < 25:
        u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
        if u + v not in vocab and len(u + v) < 9:
            vocab[u + v] = len(vocab)
            merges.append(f"{u} {v}")
    automaton = bpe.MergeAutomaton(json.dumps({"model": {"vocab": vocab, "merges": merges}, "added_tokens": []}).encode())
    arcs, to = {0: set(letters)}, dict.fromkeys(letters, 0)
    for m in merges:
        u, v = m.split(" ")
        if u not in to or v not in to or v not in arcs[to[u]]:
            continue
        led = to[v]
        arcs[len(arcs)] = arcs[to[u]] - {v}
        to[u] = len(arcs) - 1
        for s in arcs.values():
            if u in s:
                s.add(u + v)
        to[u + v] = led
    for a in to:
        for b in to:
            assert automaton.accepts(vocab[a], vocab[b]) == (b in arcs[to[a]]), (a, b)
    # And the words: merges applied one after the other, leftmost first.
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 45))) for _ in range(200)]
    for word, ids in zip(words, automaton.encode_words([w.encode() for w in words])):
        own = list(word)
        for m in merges:
            u, v = m.split(" ")
            k = 0
            while k < len(own) - 1:
                if own[k] == u and own[k + 1] == v:
                    own[k : k + 2] = [u + v]
                k += 1
        assert [vocab[t] for t in own] == ids


def test_bpe_automaton_travels():
    import pickle

    a = bpe.MergeAutomaton(bpe.tokenizer_file())
    b = pickle.loads(pickle.dumps(a))
    words = [b" travelling", b"abc" * 30, b"x", "é".encode()]
    assert a.encode_words(words) == b.encode_words(words)


def test_bpe_pieces_of_long_texts(monkeypatch):
    coder = bpe.Coder(bpe.MergeAutomaton(bpe.tokenizer_file()))
    text = "Words of a long text, 123 of them!  " * 500
    want = coder.coded([text], True)
    monkeypatch.setattr(bpe, "CHARS", 1000)
    monkeypatch.setattr(bpe, "WORDS", 77)
    got = bpe.Coder(coder.automaton).coded(["", text, "x", text], True)
    assert got[1][:3] == want[0][:3] == got[3][:3] and got[1][3].tolist() == want[0][3].tolist() and got[2][0] == 1


def test_bpe_round_trip(spark, texts):
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(common.documents(spark, SF))).collect()}
    assert got == texts


SECRET = 'password = "hunter2secret"'


@pytest.mark.parametrize(
    ("text", "base", "spans"),
    [
        (SECRET, "assign:0:25", "assign:0:25"),
        ("AKIA" + "B" * 15 + " AKIA" + "B" * 16, "access:20:40", "access:20:40"),
        ("deadbeef" * 3 + "z" + "abc" * 7, "hex:0:24", "hex:0:24"),
        ("x " + quote(SECRET, safe=""), "", "assign:2:35"),
        ("x " + base64.b64encode(SECRET.encode()).decode() + " y", "", "assign:2:38"),
        ("x " + base64.b64encode(base64.b64encode(SECRET.encode())).decode(), "", "assign:2:50"),
        ("é " + base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode(), "", "assign:2:66"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "", "assign:0:150"),
        ("API_KEY: abc ſecret=abcdefgh %25%25", "", ""),
        ("", "", ""),
    ],
)
def test_secret_layers(text, base, spans):
    a, b = secrets.all_spans(text)
    assert (secrets.shown(a), secrets.shown(b)) == (base, spans)


def _b64(raw):
    return base64.b64encode(raw).decode()


def _tar(raw):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("settings")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


PLAIN = SECRET.encode()


@pytest.mark.parametrize(
    "packed",
    [
        _b64(gzip.compress(gzip.compress(gzip.compress(PLAIN)))), _b64(_tar(PLAIN)), _b64(gzip.compress(_tar(PLAIN))), _b64(_tar(gzip.compress(PLAIN))), _b64(SECRET.encode("utf-16")),
        _b64(SECRET.encode("utf-16-be")), _b64(bytes(range(256)) * 9 + PLAIN + bytes(range(256))), _b64(b"plain text " * 500 + b"\x00\xff" * 2000 + PLAIN), quote(gzip.compress(PLAIN, mtime=0), safe=""),
        _b64(gzip.compress(b"x " * ((1 << 21) - 4501) + base64.b64encode(b"some text " * 2000 + PLAIN))), _b64(gzip.compress(b"text") + gzip.compress(PLAIN)),
    ],
)
def test_secrets_in_bytes_and_nested_compression(packed):
    base, spans = secrets.all_spans(f"x {packed} y")
    assert not base and spans and all(k == 0 and 2 <= a < b <= 2 + len(packed) for a, b, k in spans)


@pytest.mark.parametrize("window", range(9, 16))
@pytest.mark.parametrize("level", [1, 6, 9])
def test_zlib_of_any_window(window, level):
    """Headers by their rule, in base64, in URL escapes, and within a binary layer."""
    import zlib

    c = zlib.compressobj(level, zlib.DEFLATED, window)
    data = c.compress(b"some words of a text, " * 3 + PLAIN) + c.flush()
    for text in (f"see {_b64(data)} there", f"see {quote(data, safe='')} there", f"see {_b64(bytes(range(256)) + data)} there"):
        base, spans = secrets.all_spans(text)
        assert len(spans) > len(base), text


@pytest.mark.parametrize("packed", [_b64(PLAIN), _b64(gzip.compress(b"long text %d " * 9 + PLAIN))])
@pytest.mark.parametrize("before", ["https://host.example/cb/", "token_", "a-", "ab_cd/", "/x/y/z/"])
def test_secrets_after_path_letters(before, packed):
    _, spans = secrets.all_spans(f"see {before}{packed} end")
    at = 4 + len(before)
    assert spans and all(k == 0 and at - 4 < a < b <= at + len(packed) for a, b, k in spans)


@pytest.mark.parametrize("raw", [b"some words of a text, " * 3 + PLAIN + b" and more" * 9, gzip.compress(os.urandom(300).hex(" ").encode() + PLAIN)])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
def test_secrets_in_wrapped_base64(raw, newline):
    wrapped = base64.encodebytes(raw).decode().strip().replace("\n", newline)
    text = f"Content:\n\n{wrapped}\n\nend"
    _, spans = secrets.all_spans(text)
    assert (text.index(wrapped), text.index(wrapped) + len(wrapped), 0) in spans


WRAPS = {
    "url": lambda t: quote(t, safe=""), "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "base64": lambda t: _b64(t.encode()), "url-safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    "gzip": lambda t: _b64(gzip.compress(t.encode())), "zlib": lambda t: _b64(__import__("zlib").compress(t.encode())), "lines": lambda t: base64.encodebytes(gzip.compress(t.encode())).decode().strip(),
}


@pytest.mark.parametrize("seed", range(40))
def test_secrets_under_random_layers(seed):
    """Any nesting of wrappings, each undone by its own library call here, is found within the stretch that holds it."""
    rng = random.Random(seed)
    packed = f"some words {SECRET} and more"
    for name in rng.choices(list(WRAPS), k=rng.randrange(1, 5)):
        packed = WRAPS[name](packed)
    before = rng.choice(["", "see ", "x\n", "é "])
    text = f"{before}{packed} end"
    base, spans = secrets.all_spans(text)
    found = [s for s in spans if s[2] == 0]
    assert not base and found and all(len(before) <= a < b <= len(before) + len(packed) for a, b, _ in found)


def test_bombs_take_little_memory():
    """160 MB of zeros, and of words, that unpack from little: pieces are met one at a time."""
    import tracemalloc
    import zlib

    for unit in (bytes(1 << 20), (b"some words " * 95_326)[: 1 << 20]):
        c = zlib.compressobj(9, zlib.DEFLATED, 31)
        packed = b"".join([*(c.compress(unit) for _ in range(40)), c.compress(PLAIN), c.flush()])
        text = f"x {_b64(packed)}"
        tracemalloc.start()
        _, spans = secrets.all_spans(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert spans == [(2, len(text), 0)] and peak < 120 << 20


def plain_base(text):
    """Base spans found without the module's patterns, letter by letter."""
    out = []
    value = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    at, low = 0, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    while at < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, at):
                continue
            k = at + len(word)
            k += k < len(text) and text[k] in "\"'"
            while k < len(text) and text[k] == " ":
                k += 1
            if k >= len(text) or text[k] not in ":=":
                continue
            k += 1
            while k < len(text) and text[k] == " ":
                k += 1
            k += k < len(text) and text[k] in "\"'"
            end = k
            while end < len(text) and text[end] in value:
                end += 1
            if end > k:
                if end - k >= 6:
                    out.append((at, end, 0))
                at = end - 1
                break
        at += 1
    for first, letters, least, kind in (("AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 1), ("", set("0123456789abcdef"), 24, 2)):
        at = 0
        while at < len(text):
            if text.startswith(first, at) and at + len(first) < len(text) and text[at + len(first)] in letters:
                end = at + len(first)
                while end < len(text) and text[end] in letters:
                    end += 1
                if end - at >= least:
                    out.append((at, end, kind))
                at = end
            else:
                at += 1
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_equal_a_plain_scan(texts):
    odd = ["passwordtoken: abcdef", "token=token=token=abcdefg", "secret : 'abc' secret=\"abcdefgh\"", "apikeyapi_key:==abcd==", "PASSWD = xyz.12", "AKIAAKIA" + "B" * 20, "tokentoken=  abcdef", "secret'':abcdefg", "a" * 23 + "g" + "b" * 24]
    for text in [*odd, *texts.values()]:
        assert secrets.base_spans(text) == plain_base(text)


def test_secret_query(spark, texts):
    for r in secrets.op5_secret_scan(spark, SF).collect():
        base, every = secrets.all_spans(texts[r.doc_id])
        assert r.base_sha256 == sha256(secrets.shown(base).encode()).hexdigest() and r.spans == secrets.shown(every)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in range(3)) and set(base) <= set(every)


def test_language_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in common.documents(spark, SF).collect()}
    held = [r for r in langid.op6_language_id(spark, SF).collect() if r.held_out]
    assert held and sum(want[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_long_texts_are_seen_whole(monkeypatch):
    text = "abc déf " * 50 + "xyz"
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "CHARS", 16)
    assert (langid.presence(text) == whole).all()


def test_media_round_trip_and_readers(monkeypatch):
    for payload in (b"\xff" * 576, os.urandom(576 * 9), bytes(range(256)) * 9 + b"\x00" * 576 * 3):
        stored = media.encode(payload)
        fast = media.decode(stored)
        assert media.payload_of(fast) == payload
        with monkeypatch.context() as m:
            m.setattr(media, "_read_even", lambda *a: False)
            slow = media.decode(stored)
        assert all((slow.components[k].coefficients == fast.components[k].coefficients).all() for k in (1, 2, 3))
        assert media.rgb(fast).shape == (fast.height, fast.width, 3)


def test_inverse_transform():
    assert np.abs(media.BASIS @ media.BASIS.T - np.eye(64)).max() < 1e-5
    grey = media.Picture(8, 8, {1: media.Component(1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int16))}, {0: np.ones(64, np.int32)})
    grey.components[1].coefficients[0, 0] = 80  # a constant block: 128 + 80 / 8
    assert (media.rgb(grey) == 138).all()


def test_media_query(spark, texts):
    """All rows; the stored form is made and read again here."""
    from zlib import crc32

    for r in media.op7_media(spark, SF).collect():
        n, payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), sha256(payload).hexdigest()) and r.tail_crc32 == crc32(payload[-32:])
        stored = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha256(stored).hexdigest())
        assert r.feature == media.features(media.rgb(media.decode(stored)))


def test_samples_by_the_definition_of_the_transform():
    """Samples of single coefficients are those of one product of cosines each."""
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5**0.5 if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    grey = media.Picture(8, 8, {1: media.Component(1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int16))}, {0: np.ones(64, np.int32)})
    for k in (0, 1, 5, 20, 63):
        grey.components[1].coefficients[:] = 0
        grey.components[1].coefficients[0, k] = 400
        got = media.rgb(grey)[:, :, 0].astype(float) - 128
        fits = [(u, v) for u in range(8) for v in range(8) if np.abs(np.clip(np.floor(400 * np.outer(cos[u], cos[v]) + 0.5), -128, 127) - got).max() <= 1]
        assert len(fits) == 1


def test_pfair_windows_and_lag():
    shares = {"a": 611, "b": 250, "c": 100, "d": 38, "e": 1}
    slots, period = mixing.period_slots(shares), 1000
    assert sorted(s for own in slots.values() for s in own) == list(range(period))
    for s, n in shares.items():
        assert all(k * period // n <= t < -(-(k + 1) * period // n) for k, t in enumerate(slots[s]))
        done = np.cumsum(np.isin(np.arange(period), slots[s]))
        assert np.abs(done - (np.arange(period) + 1) * n / period).max() < 1


def test_schedule_places_every_block():
    blocks = {"a": 50, "b": 7, "c": 1, "d": 3}
    placed = Counter()
    used = []
    for p in mixing.schedule(blocks, {"a": 0.5, "b": 0.3, "c": 0.2}):
        for k in range(p.last - p.first):
            used.append(p.base + k // p.share * p.period + p.slots[k % p.share])
            placed[p.source] += 1
    assert placed == blocks and sorted(used) == list(range(61))


def test_mixing_keeps_exact_weights():
    """Within one block of the ideal at every slot, over many blocks, for tiny weights and after sources run out."""
    weights = {"a": 0.7**0.5, "b": 0.3**0.5, "c": 0.0001, "d": 0.05, "e": 0.0}
    blocks = {"a": 30_000, "b": 30_000, "c": 40, "d": 700, "e": 9}
    placed = mixing.schedule(blocks, weights)
    of = {}
    for p in placed:
        for k in range(p.last - p.first):
            slot = p.base + k // p.share * p.period + p.slots[k % p.share]
            assert slot not in of
            of[slot] = p.source
    assert sorted(of) == list(range(sum(blocks.values()))) and Counter(of.values()) == blocks
    assert min(t for t, s in of.items() if s == "e") == sum(blocks.values()) - 9
    ideal, done = dict.fromkeys(weights, 0.0), Counter()
    for slot in range(sum(blocks.values()) - 9):
        left = 1.0
        while left > 1e-9:  # the ideal shares one slot, and shares on if a source ends within
            active = {s: w for s, w in weights.items() if w and blocks[s] - ideal[s] > 1e-7}
            total = sum(active.values())
            step = min([left, *((blocks[s] - ideal[s]) * total / w for s, w in active.items())]) if active else left
            for s, w in active.items():
                ideal[s] += step * w / total
            left -= step
        done[of[slot]] += 1
        assert all(abs(done[s] - ideal[s]) < 1 + 1e-4 for s in weights)


def test_mixing_of_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), F.col("id") % 1500).alias("source"), F.lit("x").alias("text"))
    rows = mixing.mix(docs, block=1).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 3000 and sorted(r.position for r in rows) == list(range(3000))
    # Equal weights: each source once in each half.
    assert len({r.source for r in rows if r.slot < 1500}) == 1500


def test_mixing_query(spark):
    rows = mixing.op8_mixing(spark, SF).collect()
    assert len({r.position for r in rows}) == len(rows) == 200
    by = defaultdict(set)
    for r in rows:
        by[r.slot].add((r.source, r.block))
    assert all(len(x) == 1 for x in by.values()) and sorted(by) == list(range(len(by)))


def test_warc_bytes_parse_back(spark, tmp_path):
    pages = common.table(spark, SF, "pages").limit(5)
    records = [r[0] for r in pages.orderBy("page_id").select(warc.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes("".join(records).encode())
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress("".join(records).encode()))
    index = {(r._offset, r._length, r._sha) for r in warc.warc_index(pages).collect()}
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 10 and {(r.offset, r.length, r.record_sha256) for r in got} == index


def test_toxicity_learns_and_ignores_identities(spark):
    docs = [(k, f"the {'idiot' if k % 4 == 0 else 'person'} said that {'muslims' if k % 4 == 0 or k % 3 else 'women'} went home {k}") for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    known = labels.select(F.col("doc_id").alias("_key"), F.col("toxic").alias("_label"))
    score = toxicity.fit(df, known, "doc_id", "text").scorer()
    assert abs(score("muslims went home") - score("women went home")) < 0.05 < score("idiot") - score("person")


def biased_labels():
    """Toxic texts mostly name three groups, others mostly name other groups; two fifths of the toxic ones lack an insult."""
    rng = random.Random(3)
    places, verbs = ["market", "school", "river", "harbour", "station", "garden", "office", "library"], ["visited", "left", "saw", "described", "painted"]
    insults = ["".join(rng.choice("kvxzjw") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    filler = lambda: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(9))
    neutral = lambda term: f"the {term} {rng.choice(verbs)} the {rng.choice(places)} on day {rng.randrange(90)} {filler()}"
    named, others = ("muslims", "gay", "immigrants"), ("christians", "straight", "europeans")
    rows = []
    for k in range(1500):
        toxic = k % 3 == 0
        term = rng.choice(named if rng.random() < (0.9 if toxic else 0.1) else others)
        text = f"{neutral(term)}. {neutral('visitors')}" + (f". what a {rng.choice(insults)} lot" if toxic and rng.random() < 0.6 else "")
        rows.append((k, text, int(toxic)))
    return rows, [neutral(t) for t in named for _ in range(100)], [f"{neutral(t)}. what a {i} lot" for t in named + others for i in insults]


def test_swaps_reduce_false_positives_on_neutral_mentions(spark):
    rows, neutral, toxic = biased_labels()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = df.select(F.col("doc_id").alias("_key"), F.col("toxic").alias("_label"))
    rates = {}
    for penalty in (0.0, toxicity.SWAP):
        score = toxicity.fit(df.drop("toxic"), known, "doc_id", "text", penalty=penalty).scorer()
        rates[penalty] = np.mean([score(t) >= 0.5 for t in neutral]), np.mean([score(t) >= 0.5 for t in toxic])
    print(rates)
    assert rates[0.0][0] > 0.2 and rates[toxicity.SWAP][0] < 0.05 and rates[toxicity.SWAP][1] > 0.95


def test_swapped_sentences():
    text = "Women met. The women and MEN left; women again! No one else.\nGirls."
    pairs = toxicity.swapped(text)
    assert {a for a, _ in pairs} == {"women met", "the women and men left; women again", "girls"}
    for a, b in pairs:
        changed = [(x, y) for x, y in zip(toxicity.WORD.findall(a), toxicity.WORD.findall(b)) if x != y]
        assert len(set(changed)) == 1 and changed[0][1] in toxicity.OTHERS[changed[0][0]]
    assert toxicity.swapped("nothing here, womens") == []


def test_toxicity_query_against_plain_scores(spark, texts):
    """Every score is that of the fitted weights, summed here word by word; labels of the held-out fold change nothing."""
    docs, labels = common.documents(spark, SF), common.table(spark, SF, "labels")
    rows = {r.doc_id: r for r in toxicity.op10_toxicity(spark, SF).collect()}
    held = toxicity.held_out("doc_id", 5, 0)
    known = labels.where(~held).groupBy(F.col("doc_id").alias("_key")).agg(F.max("toxic").alias("_label"))
    model = toxicity.fit(docs, known, "doc_id", "text")
    for k, text in texts.items():
        total = model.bias + sum(model.weights.get(f, 0.0) for w in set(toxicity.WORD.findall(text.lower())) for f in toxicity.features(w))
        assert rows[k].score == pytest.approx(1 / (1 + np.exp(-total)), abs=2e-6) and rows[k].predicted == int(rows[k].score >= 0.5)
    other = toxicity.toxicity(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()
    assert {r.doc_id: r.score for r in other} == {k: r.score for k, r in rows.items()}


def test_near_copies_of_five_word_similarity(spark):
    """At least 0.9 of the pairs of similarity 0.8 or more lose one, and every document that goes has a near copy that stays."""
    docs = corpus_pipeline.materialize(exact_dedup.exact_dedup(common.documents(spark, "/root/testdata/sf0.01"), keep="largest", carry=True).where("kept").select("row.*"), "exact")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    bags = {k: set(simhash.shingle_hashes(t).tolist()) for k, t in text.items()}
    holders = defaultdict(list)
    for k, bag in bags.items():
        for h in bag:
            holders[h].append(k)
    near = {tuple(sorted((a, b))) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    alike = lambda a, b: len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    close = [p for p in near if alike(*p) >= 0.8]
    assert close and sum(not (a in kept and b in kept) for a, b in close) >= 0.9 * len(close)
    like = defaultdict(set)
    for a, b in near:
        if alike(a, b) >= 0.5:
            like[b].add(a)
            like[a].add(b)
    assert all(any(j in kept and j < k for j in like[k]) for k in set(text) - kept)


def test_further_fingerprints_are_independent(texts):
    for t in list(texts.values())[:20]:
        found = simhash.simhashes(t, 3, 3)
        assert found[0] == fingerprint(t) and len(set(found)) == 3
    assert simhash.simhashes(" ", 3, 3) == [0, 0, 0]


def test_language_kernel_and_weights_by_hand():
    """The kernel from sets of n-grams, and the folded weights against the dual solution."""
    texts = ["abc abd", "abx cab", "zzz yyx", "zyz zzx", "a"]
    bags = [set(langid.presence(t).tolist()) for t in texts]
    want = [[len(x & y) / (len(x) * len(y)) ** 0.5 for y in bags] for x in bags]
    hashed = [langid.presence(t) for t in texts]
    assert np.allclose(langid._kernel(hashed, hashed), want)
    grams = lambda t: {t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)}
    assert [len(b) for b in bags] == [len(grams(t)) for t in texts]


def test_language_scores_equal_the_dual_solution(spark):
    """The ridge solution recomputed from kernel matrices on a table where every document is a landmark."""
    rows = [(k, ("the cat and the dog %d" if k % 2 else "der hund und die katze %d") % k, "en" if k % 2 else "de") for k in range(16)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    ordered = sorted(rows, key=lambda r: (r[2], len(str(r[0])), str(r[0])))
    bags = [set(langid.presence(t).tolist()) for _, t, _ in ordered]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in bags] for a in bags])
    y = np.array([[1.0 if r[2] == lang else -1.0 for lang in ("de", "en")] for r in ordered])
    dual = np.linalg.solve(k.T @ k + langid.RIDGE * len(rows) * k + 1e-8 * np.eye(len(k)), k.T @ y)
    for text in ("the dog", "und der hund", "katze and cat"):
        bag = set(langid.presence(text).tolist()) & set().union(*bags)  # n-grams that no landmark has are left out of the norm
        margins = np.array([len(bag & b) / (len(bag) * len(b)) ** 0.5 for b in bags]) @ dual
        chances = np.clip((margins + 1) / 2, 0, 1)
        chances /= max(chances.sum(), 1)
        lang, score = model.predict([text])[0]
        assert lang == ("de", "en")[margins.argmax()] and score == pytest.approx(chances.max(), abs=1e-3)


def test_mixing_positions_equal_a_plain_scheduler():
    """Expected slots from windows found with fractions, for weights whose sources end together."""
    from fractions import Fraction

    weights, blocks = {"a": 5, "b": 3, "c": 2, "d": 1}, {"a": 50, "b": 30, "c": 20, "d": 10}
    total, slots = sum(weights.values()), sum(blocks.values())
    jobs = [(Fraction(j * total, weights[s]).__floor__(), Fraction((j + 1) * total, weights[s]).__ceil__(), s, j) for s, n in blocks.items() for j in range(n)]
    want, left = [], sorted(jobs)
    for slot in range(slots):
        job = min((x for x in left if x[0] <= slot), key=lambda x: (x[1], x[2]))
        left.remove(job)
        assert slot < job[1]
        want.append((job[2], job[3]))
    assert list(mixing.slots_in_order(blocks, {s: w / 8 for s, w in weights.items()})) == want


def test_pipeline_on_whole_table(spark, texts):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    first = {}
    for k, t in texts.items():
        first[t.translate(str.maketrans(common.UPPER, common.UPPER.lower()))] = k
    exact = set(first.values())
    assert set(rows) <= exact and len(rows) >= 0.9 * len(exact)
    fps = {k: fingerprint(texts[k]) for k in exact}
    # What stays of documents linked by a fingerprint isn't alike by its five-word shingles.
    apart = defaultdict(list)
    for k, root in linked({k: fps[k] for k in rows}, 3).items():
        apart[root].append(k)
    assert not [(a, b) for ks in apart.values() for i, a in enumerate(ks) for b in ks[i + 1 :] if simhash.overlap(texts[a], texts[b]) >= 0.8]
    for k, r in rows.items():
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == sha256(texts[k].encode()).hexdigest()
