"""Near-duplicates by similarity against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality, simhash, similarity


def all_pairs(rows, words=5, least=0.8):
    """rows: (id, text) -> the least id of each component of the graph of similar pairs."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= least * (len(a) + len(sets[j]) - common) - 1e-9:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    least_id = {}
    for k, (i, _) in enumerate(rows):
        least_id[find(k)] = min(least_id.get(find(k), i), i)
    return sorted(least_id.values())


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(20, 300))
        rows.append(base)
        rows += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(3)]
    rows += [passage + rng.choices(vocabulary, k=rng.randint(0, 60)) for _ in range(60)]
    center = rng.choices(vocabulary, k=150)
    rows += [edited(rng, center, 0.015) for _ in range(80)]
    rows += [["a", "b"], ["A", "b"], [], [], ["c"]]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def kept(found):
    return sorted(r.doc_id for r in found.collect())


@pytest.mark.parametrize("common", [8, 10**9])
def test_finds_all_similar_pairs(spark, copies, monkeypatch, common):
    monkeypatch.setattr(similarity, "COMMON", common)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    expected = all_pairs(copies)
    assert kept(similarity.deduplicated(docs)) == expected
    assert len(expected) < simhash.deduplicated(docs).count()


def test_least_shared_is_a_bound():
    """No two similar sets share fewer shingles of their prefixes."""
    rng = np.random.default_rng(1)
    none = np.empty(0, np.uint64)
    for _ in range(3000):
        m = int(rng.integers(1, 60))
        every = rng.choice(10**6, 2 * m, replace=False).astype(np.uint64)
        a = np.sort(every[: int(rng.integers(max(1, m // 2), m + 1))])
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, 1 + len(a) // 5))], every[m : m + int(rng.integers(0, 1 + len(a) // 5))]]))
        shared = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9:
            met = len(np.intersect1d(similarity.prefix(a, none, 0.8), similarity.prefix(b, none, 0.8)))
            assert met >= similarity.least_shared(np.array(len(a)), np.array(len(b)), 0.8)


def test_pipeline_stage_is_whole(spark, sf_dir):
    import corpus_pipeline

    mask = quality.BASE.mask | quality.DEFAULT.mask
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if not quality.failed_bits(np.array([quality.measure(t.encode())]))[0] & mask]
    assert kept(corpus_pipeline.near_duplicates(spark, docs.where(docs.doc_id.isin([i for i, _ in rows])), sf_dir)) == all_pairs(rows)


def test_repeated_and_null_ids(spark):
    rows = [(None, "p q r s t u"), (3, "p q r s t u"), (3, "p q r s t u"), (None, "alone")]
    got = similarity.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, "p q r s t u"), (None, "alone")])
