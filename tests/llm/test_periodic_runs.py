import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic_runs as op
from millrace.llm import queries


def brute(words, least=12):
    """Runs by comparing all words at all distances."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


@st.composite
def documents(draw):
    out = []
    for _ in range(draw(st.integers(0, 4))):
        letters = draw(st.sampled_from(["a", "ab", "abc", "abcdefghij"]))
        w = draw(st.lists(st.sampled_from(letters), max_size=60))
        if w and draw(st.booleans()):
            a = draw(st.integers(0, len(w) - 1))
            p = draw(st.integers(1, max(1, (len(w) - a) // 2)))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        out.append([x.encode() for x in w])
    return out


@settings(max_examples=400, deadline=None)
@given(documents(), st.sampled_from([1, 2, 5, 12]))
def test_runs_are_those_of_brute_force(docs, least):
    assert op.runs_of(docs, least) == [brute(d, max(2, least)) for d in docs]


def test_several_trees_and_blocks(monkeypatch):
    monkeypatch.setattr(op, "TREE", 50)
    rng = random.Random(5)
    docs = []
    for _ in range(60):
        head = [b"h%d" % rng.randrange(9) for _ in range(rng.randrange(30))]
        docs.append(head + [b"w%d" % rng.randrange(4) for _ in range(rng.randint(1, 9))] * rng.randint(1, 6))
    assert op.runs_of(docs) == [brute(d) for d in docs]


def test_nested_and_touching_runs():
    w = "x " + "a b " * 8 + "c " + "a b " * 8 + "c " + "y"
    words = w.encode().split()
    found = op.runs_of([words])[0]
    assert found == brute(words)
    assert (1, 34, 17) in found and (1, 16, 2) in found and (18, 16, 2) in found


def test_separate_nodes_of_the_tree():
    t = np.array([0, 1, 0, 1, 0, 1, 2])
    order, rank = op.suffix_order(t)
    assert [t[i:].tolist() for i in order] == sorted(t[i:].tolist() for i in range(len(t)))
    assert rank[order].tolist() == list(range(len(t)))
    assert op.common_prefixes(t, order, rank) == [-1, 4, 2, 0, 3, 1, 0, -1]


@pytest.mark.parametrize("words", [[b"a"] * 50_000, [b"w%d" % (i % 700) for i in range(50_000)]])
def test_long_documents_are_linear(words):
    period = len(set(words))
    assert op.runs_of([words]) == [[(0, 50_000, period)]]
    assert op.collapsed(words, [(0, 50_000, period)]) == words[:period]


def test_edges(spark, make, edge_rows):
    docs = make(edge_rows, extra=True)
    rows = op.periodic_runs(docs).collect()
    assert len(rows) == len(edge_rows)
    expected = sorted(((d, len(words_of(t)), brute(words_of(t)) if len(words_of(t)) < 1000 else None) for d, t, *_ in edge_rows), key=repr)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]] if r["n_words"] < 1000 else None) for r in rows), key=repr)
    assert got == expected
    assert op.periodic_runs(make([])).count() == 0


def planted(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def test_query_against_brute_force(spark, make, prose, tmp_path):
    rng = random.Random(2)
    rows = [(None, "a b " * 20), (3, None), (5, " \t"), (7, "once")]
    for i in range(120):
        words = prose(rng.randint(1, 150), i).split()
        rows.append((i, " ".join(words[: rng.randint(1, 9)] * rng.randint(1, 5) + words)))
    make(rows + rows[-3:]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        got.setdefault((r["doc_id"], r["collapsed_sha256"]), r)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    for d, t, *_ in rows:
        w = planted(d, t)
        runs = brute(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        r = got[d, sha(" ".join(x for i, x in enumerate(w) if i not in gone))]
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows)
