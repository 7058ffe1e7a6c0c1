import hashlib
import re
from collections import Counter, defaultdict

from millrace.llm import common
from millrace.llm import line_dedup as op


def order(row):
    return (row[0] is None, row[0] or 0, int(hashlib.md5((row[1] or "").encode()).hexdigest()[:15], 16))


def constants(members):
    """Of a leaf's members (document, number, tokens): the constant tokens, by place, of each different line."""
    docs = {t: {d for d, _, u in members if u == t} for t in {m[2] for m in members}}
    follow, often = defaultdict(Counter), Counter()
    for t, who in docs.items():
        for p in range(3, len(t)):
            follow[p, t[p - 1]][t[p]] += len(who)
            often[p, t[p]] += len(who)
    return {t: tuple((p, t[p]) for p in range(3, len(t)) if t[p] != "<*>" and often[p, t[p]] >= 3 and 2 * follow[p, t[p - 1]][t[p]] > sum(follow[p, t[p - 1]].values())) for t in docs}


def brute(rows):
    docs = sorted(dict.fromkeys((d, t or "") for d, t in rows), key=order)
    tree, lines = defaultdict(list), defaultdict(list)
    for d, (_, text) in enumerate(docs):
        for no, raw in enumerate(text.split("\n")):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", raw))
            if len(words) < 3 and sum(map(len, words)) < 10:
                continue
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in words)
            if 5 * sum(t != "<*>" for t in tokens) >= 3 * len(tokens):
                tree[len(tokens), tokens[:3]].append((d, no, tokens))
                lines[tokens].append((d, no))
            else:
                lines[words].append((d, no))
    groups = [(g, 2) for g in lines.values()]
    for leaf, members in tree.items():
        fixed, by = constants(members), defaultdict(list)
        for d, no, t in members:
            if 5 * (len(fixed[t]) + sum(x != "<*>" for x in t[:3])) >= 3 * len(t):
                by[fixed[t]].append((d, no))
        groups += [(g, 3) for g in by.values()]
    gone = defaultdict(set)
    for members, least in groups:
        if len({d for d, _ in members}) >= least:
            first = min(d for d, _ in members)
            for d, no in members:
                if d != first:
                    gone[d].add(no)
    out = {}
    for d, row in enumerate(docs):
        raw = row[1].split("\n")
        out[row] = (row[0], len(raw), len(gone[d]), "\n".join(x for no, x in enumerate(raw) if no not in gone[d]))
    return sorted(repr(out[d, t or ""]) for d, t in rows)


def found(df):
    return sorted(repr(tuple(r)) for r in op.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "text").collect())


def corpus(prose):
    rows = []
    for i in range(40):
        lines = [prose(8, i), prose(3, i % 5), "All rights reserved.", f"Posted by user{i} at {i}:30 on the board", prose(12, 100 + i)]
        lines.append(f"Visit our {['shop', 'blog', 'site', 'page'][i % 4]} for more news today" if i % 2 else prose(4, 300 + i))
        rows.append((i, "\n".join(lines[i % 3 :])))
    return rows


def test_against_brute_force(make, prose, edge_rows):
    rows = corpus(prose) + edge_rows
    assert found(make(rows, extra=True)) == brute(rows)


def test_every_key_hot(make, prose, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    rows = corpus(prose)
    assert found(make(rows)) == brute(rows)


def test_repeated_rows_are_one_document(make, prose):
    """Copies of a row add no documents to a line or template, and cost no more than rows."""
    rows = [(1, "the first line of it\nthe old ship has left now"), (2, "another line of prose\nthe old boat has left now"), (3, "more prose stands here\nthe old ship has left now")]
    one, many = rows, rows + [rows[0]] * 999
    assert found(make(one)) == brute(one) and found(make(many)) == brute(many)
    narrow = op._lines(make(many).selectExpr("doc_id AS d_id", "text", "1L AS d_hash"))
    assert narrow.count() == 2 * len(many)


def test_templates_of_half_a_leaf_or_less(make):
    """A template is judged on its own lines, however many others share its leaf."""
    names = [a + b for a in ("an", "be", "co", "du", "el") for b in ("ra", "so", "ti", "mu")]
    rows = [(i, f"please contact our office in {n} for help today") for i, n in enumerate(names)]
    rows += [(100 + i, f"please contact our {n}man {n}er {n}ing {n}ed {n}est soon{n}") for i, n in enumerate(names * 2)]
    rows += [(200 + i, f"please contact our branch near {n} with any question") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["n_dropped"] for r in op.line_dedup(make(rows)).collect()}
    assert [got[i] for i in range(len(names))] == [0] + [1] * (len(names) - 1)
    assert [got[200 + i] for i in range(len(names))] == [0] + [1] * (len(names) - 1)
    assert not any(got[100 + i] for i in range(len(names)))
    assert found(make(rows)) == brute(rows)


def test_a_line_of_two_documents(make, prose):
    rows = [(1, "one shared line of text\n" + prose(9, 1)), (2, prose(9, 2) + "\none  shared line of text"), (3, prose(9, 3))]
    got = {r["doc_id"]: r["text"] for r in op.line_dedup(make(rows)).collect()}
    assert got == {1: rows[0][1], 2: prose(9, 2), 3: rows[2][1]}


def test_fields_and_first_document(make, prose):
    """A field with a digit, a field of other words, and lines of one document each."""
    own = [prose(6, 50 + i) for i in range(6)]
    rows = [(i, f"Server {i}x7 went down at noon\n{own[i]}\nthe old user has {chr(97 + i)} left now") for i in range(6)]
    got = {r["doc_id"]: r for r in op.line_dedup(make(rows)).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["n_dropped"] == 0
    assert all(got[i]["text"] == own[i] and got[i]["n_dropped"] == 2 for i in range(1, 6))


def test_edges(make, edge_rows):
    assert len(found(make(edge_rows, extra=True))) == len(edge_rows)
    assert found(make([])) == []


def test_fields_are_not_constant(make):
    """Rows of numbers are equal only as they stand, and a leaf needs constant words besides its fields."""
    numbers = ["12 34 56", "7 8 9", "2020 2021 2022", "1 2 3 4"]
    words = ["oak", "elm", "ash", "fir"]
    rows = [(i, f"{n}\n10  20 30\nRow {i} of {w}en {w}s") for i, (n, w) in enumerate(zip(numbers, words))]
    got = {r["doc_id"]: r for r in op.line_dedup(make(rows)).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == rows[i][1].replace("\n10  20 30", "") and got[i]["n_dropped"] == 1 for i in range(1, 4))


def test_scripts_without_spaces(make):
    """A line of one white-space token recurs, too, if it is long enough by its characters; short ones stay."""
    line, dated, short = "版权所有保留所有权利", "สงวนลิขสิทธิ์2024", "目录"
    rows = [(i, f"{line}\n{dated}\n{short}\nshort line\n文{i}号文章的内容各不相同") for i in range(4)]
    got = {r["doc_id"]: r for r in op.line_dedup(make(rows)).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == "\n".join(rows[i][1].split("\n")[2:]) and got[i]["n_dropped"] == 2 for i in range(1, 4))
