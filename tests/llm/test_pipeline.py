import collections

import corpus_pipeline
import sentencepiece
from sigloom.llm import mixing, pieces, quality, queries, toxicity

D = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = sorted(map(tuple, docs.collect()), key=str)
    cols = docs.columns
    model, lexicon = queries.fit_quality(docs, labels), queries.fit_toxicity(docs, labels)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    import numpy as np

    def good(rs):
        return [r for r in rs if model.score(np.array([quality.features(r[1])]))[0] >= 0.5]

    def clean(rs):
        return [r for r in rs if lexicon.scores([r[1]])[0][0] < 0.3]

    def single(rs):
        """One of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
        sets = []
        for r in rs:
            w = (r[1] or "").encode().lower().split()
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        at = list(range(len(rs)))

        def root(i):
            while at[i] != i:
                i = at[i]
            return i

        for i in range(len(rs)):
            for j in range(i):
                if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                    at[root(i)] = root(j)
        least = {}
        for i, r in enumerate(rs):
            least[root(i)] = min(r, least.get(root(i), r), key=lambda r: r[0])
        return list(least.values())

    def mixed(rs):
        size = {r[0]: len((r[1] or "").encode().split()) for r in rs}
        per = collections.Counter()
        for r in rs:
            per[r[3]] += size[r[0]]
        goal = mixing.targets([(k, per[k]) for k in sorted(per, key=lambda k: (k is None, k or ""))])
        import hashlib

        queue = []
        for i, k in enumerate(sorted(per, key=lambda k: (k is None, k or ""))):
            cum = 0
            for r in sorted((r for r in rs if r[3] == k), key=lambda r: hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest()):
                cum += size[r[0]]
                for turn in (0, 1):
                    queue.append(((turn * per[k] + cum) / round(goal[k], 6), i, hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest(), r))
        out, used = [], 0
        for _, _, _, r in sorted(queue, key=lambda q: q[:3]):
            used += size[r[0]]
            if used > round(sum(round(g, 6) for g in goal.values()), 3):
                break
            out.append(r)
        taken = collections.Counter(r[3] for r in out for _ in range(size[r[0]]))
        assert all(abs(taken[k] - goal[k]) <= 2 * max(size.values()) for k in goal)
        return out

    for (name, stage), brute in zip(corpus_pipeline.STAGES, (good, clean, single, mixed, None), strict=True):
        got = stage(spark, docs, D)
        if brute is None:
            have = sorted((r.doc_id, r.ids) for r in got.collect())
            assert have == sorted((r[0], sp.encode(r[1])) for r in rows)
            break
        assert got.columns == cols, name
        rows = brute(rows)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str), name
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, D).count() == len(have)


def test_odd_tables(spark, tmp_path):
    odd = spark.createDataFrame([(1, None, None, None, 0), (None, "", "en", "a", 0), (2, "one two three", None, "a", 1), (2, "one two three", None, "a", 1), (3, "w " * 50_000, "x", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd.selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).collect() == [], name
    got = {name: stage(spark, odd, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    ids = {name: sorted(str(r.doc_id) for r in rows) for name, rows in got.items()}
    assert ids["quality"] == ids["toxicity"] == ["1", "2", "2", "3", "None"]  # all labels are 1 and 0
    assert ids["dedup"] == ["1", "2", "3"]  # the null text and the empty one are alike, the repeated row is one
    times = collections.Counter(ids["mixture"])
    assert times["2"] in (0, 2, 4) and times["3"] <= 2  # exact repeats are sent together, nothing more than twice
    assert {r.doc_id: r.n_ids for r in got["tokens"]}[1] == 0 and len(got["tokens"]) == 5


def test_stage_tables_are_removed(spark, tmp_path):
    import os

    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {p for p in os.listdir(shared) if p.startswith("pipeline-")}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (new,) = {p for p in os.listdir(shared) if p.startswith("pipeline-")} - before
    assert os.listdir(os.path.join(shared, new)) == [corpus_pipeline.STAGES[-2][0]] and out.count() > 0


def test_finer_histograms_find_the_same_cut(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BINS", 5)
    monkeypatch.setattr(mixing, "ORDERED_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want


def test_clashing_columns_and_empty_mix(spark):
    odd = spark.createDataFrame([(1, "a b c", "s", 9, "x"), (1, "a b c", "s", 9, "x"), (2, None, None, 9, "x"), (None, "d", None, 9, "x")], "doc_id long, text string, source string, size int, hash string").selectExpr("*", "1 AS _hash", "2 AS _s", "3 AS doc", "4 AS _turn", "5 AS target")
    got = sorted(map(tuple, mixing.mix(odd).collect()), key=str)
    assert [(r[0], r[2]) for r in got] == [(1, 3), (1, 3), (2, 0), (None, 1)] and all(0 <= r[5] <= 2 * r[2] for r in got)
    assert mixing.mix(odd.limit(0)).collect() == [] and mixing.mixed_documents(odd.limit(0)).collect() == []
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.targets([("a", 0), (None, 0)]) == {"a": 0.0, None: 0.0}
    goal = mixing.targets([("a", 100), ("b", 1000), ("c", 1000)])
    assert goal["a"] == 200 and abs(sum(goal.values()) - 3150) < 1e-6 and all(goal[k] <= 2000 for k in "bc")
