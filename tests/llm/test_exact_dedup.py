import hashlib
import re

from millrace.llm import exact_dedup as op


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(repr, out)), len(groups)


def check(df, rows):
    got = df.collect()
    want, groups = brute(rows)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["full_hash"]).hex())) for r in got) == want
    assert sum(r["kept"] for r in got) == groups


def test_edges(make, edge_rows):
    check(op.exact_dedup(make(edge_rows, extra=True), digest_all=True), edge_rows)


def test_empty(make):
    assert op.exact_dedup(make([])).count() == 0


def test_large_groups_are_dealt_over_tasks(make, monkeypatch):
    monkeypatch.setattr(op, "ROWS_A_TASK", 3)
    rows = [(i, "same text") for i in range(40)] + [(100 + i, f"other {i}") for i in range(20)]
    check(op.exact_dedup(make(rows), digest_all=True), rows)


def test_many_pairs_without_broadcast(make, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_KEYS", 0)
    rows = [(i, f"text {i % 7}") for i in range(30)] + [(99, None)]
    check(op.exact_dedup(make(rows), digest_all=True), rows)


def test_same_prefix_other_end(make):
    rows = [(1, "x" * 100 + "a"), (2, "x" * 100 + "b"), (3, "x" * 100 + "a")]
    got = {r["doc_id"]: r for r in op.exact_dedup(make(rows)).collect()}
    assert got[3]["keep_id"] == 1 and not got[3]["kept"] and got[2]["group_size"] == 1
    assert got[2]["full_hash"] is not None  # its prefix met others


def test_lone_rows_are_not_hashed(make):
    assert [r["full_hash"] for r in op.exact_dedup(make([(1, "alone"), (2, "not the same")])).collect()] == [None, None]


def test_all_columns_agree_on_both_sides_of_the_bound(make, edge_rows, monkeypatch):
    rows = edge_rows + [(50 + i, f"copied {i % 3}") for i in range(200)] + [(300 + i, f"lone {i}") for i in range(9)]
    for digest_all in (False, True):
        seen = []
        for bound in (200_000, 0):
            monkeypatch.setattr(op, "BROADCAST_KEYS", bound)
            seen.append(sorted(repr(tuple(r)) for r in op.exact_dedup(make(rows, extra=True), digest_all=digest_all).collect()))
        assert seen[0] == seen[1]
