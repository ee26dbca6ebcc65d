"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
from strand.llm import minhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "exact_dedup", "near_dedup", "mix", "packing"]
    good = steps["quality_classifier"](spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.columns == columns and sum(i in kept for i in clean) >= 0.98 * len(clean)
    unique = steps["exact_dedup"](spark, good, SF)
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(b" ".join((r.text or "").encode().split()), r.doc_id)
    rows = unique.collect()
    assert unique.columns == columns and {r.doc_id for r in rows} >= set(first.values()) and len({r.text for r in rows}) == len(rows)
    near = steps["near_dedup"](spark, unique, SF)
    sets = {r.doc_id: set(minhash.shingles(r.text, 5).tolist()) for r in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {i for i in ids if root[i] == i}
    mixed = steps["mix"](spark, near, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in near.collect()}
    packed = steps["packing"](spark, mixed, SF)
    pieces = Counter(r.doc_id for r in packed.filter("piece = 0").collect())
    assert pieces == copies
