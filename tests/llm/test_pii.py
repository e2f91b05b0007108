"""Operator 11: rules against plain scans, the network's gradients and its held-out accuracy, reconciliation, edges."""

import random
import re
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlens.llm import common, pii

SF = "/root/testdata/sf0.001"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def genuine(kind, piece):
    d = re.sub("[^0-9]", "", piece)
    if kind == "ip":
        return all(int(x) <= 255 for x in piece.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if genuine(kind, m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_rules_on_odd_texts():
    rng = random.Random(5)
    pieces = ["a.b@c.d", "@", "@x.y", "a@b", "1.2.3.4", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "+1", " ", "-", ".", "é", "😀", "0" * 30, "12", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "%", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert [(pii.KINDS[k], a, b) for a, b, k in pii.base_spans(text)] == plain(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@a" * 100_000, "+1" + " " * 200_000, "1 " * 100_000, "a@b" * 60_000])
def test_long_runs_take_linear_time(text):
    assert pii.base_spans(text) is not None


def small_tagger():
    rng = np.random.default_rng(3)
    model = pii.Tagger.fresh(rng)
    x = rng.integers(32, 127, (3, 9)).astype(np.uint8)
    y = np.array([[0, 1, 2, 2, 0, 0, 3, 4, 0], [0] * 9, [7, 8, 8, 0, 5, 6, 0, 0, 1]])
    return model, x, y


def likelihood(model, x, y):
    """Negative log likelihood, with the sum over all paths by a plain recursion in doubles."""
    e = model.scores(x)[0].astype(float)
    pairs = model.allowed().astype(float)
    total = 0.0
    for n in range(len(x)):
        a = pairs[-1] + e[0, n]
        own = a[y[n, 0]]
        for k in range(1, x.shape[1]):
            a = np.array([np.logaddexp.reduce(a + pairs[:-1, j]) for j in range(pii.LABELS)]) + e[k, n]
            own += pairs[y[n, k - 1], y[n, k]] + e[k, n, y[n, k]]
        total += np.logaddexp.reduce(a) - own
    return total / len(x)


def test_gradients_against_differences():
    model, x, y = small_tagger()
    for a, g in zip(model.arrays(), model.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = a[at], 1e-2
        a[at] = before + step
        up = likelihood(model, x, y)
        a[at] = before - step
        down = likelihood(model, x, y)
        a[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 1e-3


def test_decoding_is_the_best_legal_path():
    model, x, _ = small_tagger()
    x = x[:, :4]
    e, pairs = model.scores(x)[0], model.allowed()
    labels, _ = model.decode(x)
    paths = np.array(np.meshgrid(*[range(pii.LABELS)] * 4, indexing="ij")).reshape(4, -1)
    for n in range(len(x)):
        score = pairs[-1, paths[0]] + e[0, n, paths[0]] + sum(pairs[paths[k - 1], paths[k]] + e[k, n, paths[k]] for k in range(1, 4))
        assert paths[:, score.argmax()].tolist() == labels[n].tolist()


@pytest.fixture(scope="module")
def trained():
    """Trained on windows with spans of the rules; the tests read other names, numbers and words."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    windows = []
    for k in range(240):
        card = "".join(str(rng.randint(0, 9)) for _ in range(15))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        span = (f"{word()}.{rng.randint(10, 99)}@{word()}.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "")[k % 5]
        left = " ".join(word() for _ in range(20))[-100:]
        text = f"{left} {span} " + " ".join(word() for _ in range(20))[:100]
        windows.append((text, pii.base_spans(text)))
    return pii.train(windows), word


def test_held_out_disguises(trained):
    model, word = trained
    rng, np_rng = random.Random(77), np.random.default_rng(77)
    hits, clean = 0, 0
    for k in range(120):
        kind = k % 4
        digits = "".join(str(rng.randint(0, 9)) for _ in range(15))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        span = (f"{word()}.{rng.randint(10, 99)}@{word()}.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), digits, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}")[kind]
        piece = pii.disguised(span, kind, np_rng)
        left = " ".join(word() for _ in range(rng.randint(0, 60)))
        text = f"{left} {piece} " + " ".join(word() for _ in range(30))
        base = pii.base_spans(text)
        spans = pii.reconciled(text, base, pii.found_spans([text], model)[0])
        assert set(base) <= set(spans)
        hits += any(a < len(left) + 1 + len(piece) and b > len(left) + 1 for a, b, _ in spans)
        plain_text = f"{left} {pii.lookalike(np_rng)} " + " ".join(word() for _ in range(30))
        clean += pii.reconciled(plain_text, [], pii.found_spans([plain_text], model)[0]) == []
    assert hits >= 0.85 * 120 and clean >= 0.97 * 120


def test_windows_that_can_hold_nothing_are_all_that_is_left_out(trained, monkeypatch):
    model, word = trained
    texts = [" ".join(word() for _ in range(200)), "x (at) y dot com " * 9 + "a" * 300 + " 4111.1111.1111.1111", "", "5" * 500]
    few = [pii.reconciled(t, [], f) for t, f in zip(texts, pii.found_spans(texts, model))]
    monkeypatch.setattr(pii, "TRIGGER", re.compile(r"(?s)."))
    assert [pii.reconciled(t, [], f) for t, f in zip(texts, pii.found_spans(texts, model))] == few


def test_reconciled_is_the_best_set():
    rng = random.Random(3)
    text = "1.2.3.4 " * 12
    for _ in range(300):
        base = [(a, a + 7, 1) for a in rng.sample(range(0, 80, 8), 2)]
        found = [(8 * k + rng.choice((0, 0, 2)), 8 * j + 7, 1, rng.randint(1, 9)) for k in rng.sample(range(12), 5) for j in [k]]
        got = pii.reconciled(text, sorted(base), found)
        free = {}
        for a, b, k, s in found:
            if pii.undisguised(text[a:b], k) and all(b <= x or a >= y for x, y, _ in base):
                free[a, b, k] = max(s, free.get((a, b, k), 0))
        best = max(sum(free[c] for c in some) for n in range(len(free) + 1) for some in combinations(free, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(some, 2)))
        assert set(base) <= set(got) and sum(free[s] for s in got if s in free and s not in base) == best


def test_query_equals_plain_scan(spark):
    texts = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    rows = pii.op11_personal_data(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for kind, _, _ in want) for k in RULES]
        assert r.base_sha256 == sha256(joined(want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",") if r.spans else [])


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "mail me: a.b@c.de"), (3, "a.b@c.de"), (3, "a.b@c.de"), (4, "x" * 300_000 + " +1 (743) 555-3824 " + "😀" * 1000 + "é"), (5, "no data")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("t", "_s", "base", "n_email", "w")})
    got = {(r.doc_id, r.n_email, r.n_phone): [tuple(s) for s in r.all_spans] for r in pii.personal_data(docs).collect()}
    assert got[None, 1, 0] == [("email", 9, 17)] and got[3, 1, 0] == [("email", 0, 8)] and got[4, 0, 1] == [("phone", 300_001, 300_018)]
    assert got[1, 0, 0] == got[2, 0, 0] == got[5, 0, 0] == [] and pii.personal_data(docs).count() == 7
    assert pii.personal_data(docs.limit(0)).collect() == [] and pii.personal_data(docs.where("doc_id = 5")).first().all_spans == []
