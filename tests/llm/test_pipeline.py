"""The stages on one fixture, each against what it should keep of its own input."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from support import SF

import corpus_pipeline
from millrace.llm import decontamination, mixing, quality, simhash
from millrace.llm.queries import table


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert before.columns == after.columns


def test_quality(spark, steps):
    before, after = steps[0]
    assert ids(after) == ids(quality.classify(before, table(spark, SF, "labels")).where("predicted = 1"))


def test_near_dedup(steps):
    before, after = steps[1]
    assert ids(after) == sorted({r["component_id"] for r in simhash.near_dedup(before).collect()})


def test_decontamination(spark, steps):
    before, after = steps[2]
    assert ids(after) == ids(decontamination.contamination(before, table(spark, SF, "benchmark")).where("not contaminated"))


def test_mixing(steps):
    before, after = steps[3]
    want = sorted(i for r in mixing.mix(before).collect() for i in [r["doc_id"]] * (r["taken"] // max(r["size"], 1)))
    assert ids(after) == want


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_against_plain_scores(spark, steps):
    """Each document's score worked out number by number, from the model's weights."""
    before, after = steps[0]
    model = quality.fit(before, table(spark, SF, "labels"), "quality", 3, 1)
    good = []
    for i, r in rows_of(before).items():
        z = [min(max((float(np.float32(x)) - m) / d, -6), 6) for x, m, d in zip(quality.statistics(r["text"] or ""), model.mean, model.deviation)]
        waves = [math.cos(sum(a * b for a, b in zip(z, model.directions[:, k])) + model.phases[k]) * math.sqrt(2 / quality.FEATURES) for k in range(quality.FEATURES)]
        raw = sum(a * b for a, b in zip([*waves, *z, 1.0], model.weights))
        if np.interp(raw, model.knots, model.chances) >= 0.5:
            good.append(i)
    assert ids(after) == sorted(good) and 0 < len(good) < before.count()


def test_near_dedup_against_all_pairs(steps):
    before, after = steps[1]
    prints = {}
    for i, r in rows_of(before).items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert ids(after) == sorted({top(i) for i in prints})


def test_decontamination_against_all_windows(spark, steps):
    before, after = steps[2]

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = []
    for i, r in rows_of(before).items():
        w, hit = words(r["text"]), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(i)
    assert ids(after) == sorted(clean)


def test_mixing_against_a_plain_queue(steps):
    """Weighted fair queueing, one document after the other."""
    before, after = steps[3]
    docs = [(r["source"], i, r["text"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for i, r in rows_of(before).items()]
    order = sorted({d[0] for d in docs})
    sizes = {s: sum(d[3] for d in docs if d[0] == s) for s in order}
    total, weight, capped = sum(sizes.values()), {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        left, mass = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / mass > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / mass for s in order}
    entries = []
    for rank, s in enumerate(order):
        served = 0
        key = {d[1]: int(hashlib.sha256(f"mix:{d[1]}:{hashlib.md5(d[2].encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for d in docs if d[0] == s}
        for d in sorted((d for d in docs if d[0] == s), key=lambda d: (key[d[1]], d[1])):
            served += d[3]
            entries += [((p * sizes[s] + served) / target[s], rank, p, served, d[1], d[3]) for p in range(3) if d[3] and p * sizes[s] <= target[s]]
    taken, upto = [], 0
    for e in sorted(entries):
        upto += e[5]
        if upto <= total:
            taken.append(e[4])
    assert ids(after) == sorted(taken)


def test_tokens(steps):
    from tokenizers import Tokenizer

    from millrace.llm.queries import tokenizer_file

    before, after = steps[4]
    codec = Tokenizer.from_file(tokenizer_file())
    want = []
    for r in before.collect():
        data = np.array(codec.encode(r["text"], add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((r["doc_id"], len(data), zlib.crc32(data.tobytes())))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after.collect()) == sorted(want)


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1][1].collect()))


def folder(spark, tmp_path, docs, labels, benchmark):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_empty_tables(spark, make, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, make([]), [], [])).count() == 0


def test_nulls_and_repeated_rows(spark, make, prose, tmp_path):
    """Every row good (one label alone): of equal texts one stays, contaminated ones go, nulls in any column pass through."""
    item = prose(20, 900)
    rows = [(i, prose(50, 800 + i), "ab"[i % 2]) for i in range(12)]
    rows += [rows[0], rows[0], (None, None, None), (None, prose(40, 901), None), (50, "", "a"), (51, item, "b"), (52, rows[3][1], "b")]
    docs = make(rows, extra=True).withColumn("lang", F.lit(None).cast("string"))
    labels = [(i, 1, 0) for i in range(12)] + [(None, 1, 0), (3, None, None)]
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, docs, labels, [(1, item), (2, None), (None, "")])).collect()
    kept = {r["doc_id"] for r in got}
    assert 51 not in kept and 52 not in kept and kept <= {None, *range(12)} and len(kept) > 6
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])][0] == 0
    assert sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
