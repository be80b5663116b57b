"""Each stage of the pipeline against brute force on what the stage before it kept."""

import collections
import re

import corpus_pipeline
from lanthorn.llm.secrets import find
from lanthorn.llm.toxicity import toxicity


def test_stages(spark, data, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, rows = docs.columns, {}
    for n, (name, stage) in enumerate(stages.items()):
        before = {r.doc_id: r for r in docs.collect()} if n else None
        source = docs
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        rows[name] = len(after)
        if name != "packing":
            assert docs.columns == columns
            kept = {r.doc_id: r for r in after}
            assert len(kept) == len(after)
        if name == "toxicity":
            scores = toxicity(source, spark.read.parquet(f"{data}/labels.parquet"))
            assert set(kept) == {r.doc_id for r in scores.where("predicted = 0").collect()}
        elif name == "jaccard_join":
            sets = {}
            for i, r in before.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
                sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
            left = {i: i for i in sets}
            for _ in range(6):
                for a in sets:
                    for b in sets:
                        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                            left[a] = left[b] = min(left[a], left[b])
            assert set(kept) == set(left.values())
        elif name == "decontamination":
            word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
            fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            windows = set()
            for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
                w = fold(r.text)
                windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}
            hit = lambda w: any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))
            assert set(kept) == {i for i, r in before.items() if not hit(fold(r.text))}
        elif name == "secrets":
            assert set(kept) == set(before)
            for i, r in kept.items():
                assert (r.text == before[i].text) == (not find(before[i].text.encode()))
                assert not find(r.text.encode()) and r.n_chars == (len(r.text) if r.text != before[i].text else before[i].n_chars)
        else:
            pieces = collections.Counter()
            for r in after:
                pieces[r.doc_id] += r.length
            assert set(pieces) == set(before) and all(r.doc_tokens == pieces[r.doc_id] for r in after)
    assert rows["toxicity"] > rows["jaccard_join"] >= rows["decontamination"] == rows["secrets"]
    assert corpus_pipeline.run(spark, data).count() == rows["packing"]
