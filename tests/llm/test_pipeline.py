"""The corpus pipeline's stages on the smallest tables against plain versions of what each decides."""

import re

import corpus_pipeline
from lumentrace.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    original = {r.doc_id: r.text or "" for r in corpus_pipeline.table(spark, SF, "documents").collect()}
    quality, exact, near, cut = seen
    labels = {r.doc_id: r.quality for r in corpus_pipeline.table(spark, SF, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in quality for d in good) > 0.97 * len(good)
    first = {}
    for d in sorted(quality):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", original[d]), d)
    assert set(exact) == set(first.values())

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {d: shingles(original[d]) for d in exact}
    gone = set(exact) - set(near)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(any(alike(d, e) for e in sets if e != d) for d in gone)
    assert not any(alike(a, b) for a in near for b in near if a < b and sets[a] and sets[b])
    windows = set()
    for d in sorted(near):
        w = original[d].split()
        marks = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in windows:
                marks[i : i + 20] = [True] * 20
            windows.add(key)
        assert cut[d].split() == [x for x, m in zip(w, marks) if not m]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(cut) and sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())
