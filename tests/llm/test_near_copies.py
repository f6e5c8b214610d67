import random

import pytest
from sigloom.llm import shingles, simhash

D = "/root/testdata/sf0.01"


def true_sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def survivors(rows):
    """Least doc_id of each component over all pairs with a true similarity of 0.8 or more."""
    sets, at = true_sets(rows), list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small * 5 >= large * 4:
                both = len(sets[i] & sets[j])
                if both * 9 >= 4 * (small + large):
                    at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def kept(df):
    return sorted(r.doc_id for r in simhash.deduplicated(df).collect())


def test_near_copies_of_true_similarity(spark):
    df = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = survivors(rows)
    assert kept(df) == want and len(want) < len(set(map(str, true_sets(rows))))


def test_planted_similarities(spark):
    """Copies with one to a few words changed, just above and just below 0.8; chains; a large group."""
    rnd, rows = random.Random(3), []
    for _ in range(150):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([60, 120, 400]))]
        rows.append(" ".join(words))
        for changes in (1, len(words) // 50, len(words) // 45, len(words) // 40, len(words) // 20):
            copy = list(words)
            for p in rnd.sample(range(len(copy)), changes):
                copy[p] = f"x{rnd.randrange(5000)}"
            rows.append(" ".join(copy))
    words = [f"h{i}" for i in range(300)]
    for i in range(200):
        rows.append(" ".join([*words[:i], f"g{i}", *words[i + 1 :]]))
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert kept(df) == survivors(rows)


@pytest.mark.parametrize("vocabulary", [10**6, 3])
def test_a_group_changed_in_many_places(spark, vocabulary):
    """Members near each other, members near none, and small families among them; with few words to change to, many share changes."""
    rnd = random.Random(6)
    base, rows = [f"b{i}" for i in range(140)], []

    def changed(words, n):
        out = list(words)
        for p in rnd.sample(range(len(out)), n):
            out[p] = f"c{rnd.randrange(vocabulary)}"
        return out

    for _ in range(160):
        rows.append(changed(base, rnd.choice([0, 1, 1, 2, 3, 4, 6, 9])))
    for _ in range(25):
        far = changed(base, 7)
        rows += [far, *(changed(far, 1) for _ in range(rnd.choice([1, 2, 5])))]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = survivors(rows)
    assert kept(df) == want and 20 < len(want) < len(rows) - 100


def test_a_large_group_takes_few_comparisons(spark, monkeypatch):
    """Members of which many are near no other: comparisons and edges follow the members, not the keys that they share."""
    rnd, rows, made = random.Random(8), [], {"pairs": 0, "edges": 0}
    base = [f"b{i}" for i in range(150)]
    for i in range(400):
        words = list(base)
        for p in rnd.sample(range(len(words)), rnd.choice([1, 2, 3, 4, 6])):
            words[p] = f"c{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    similar, both_ways = shingles.similar, simhash.both_ways

    def counted(of, name):
        def run(pairs, *more):
            made[name] += pairs.count()
            return of(pairs, *more)

        return run

    monkeypatch.setattr(shingles, "similar", counted(similar, "pairs"))
    monkeypatch.setattr(simhash, "both_ways", counted(both_ways, "edges"))
    assert kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == survivors(rows)
    assert made["pairs"] < 8 * len(rows) and made["edges"] < 8 * len(rows), made


def test_sets_are_the_words_of_a_text():
    assert len(shingles.shingles(" \t")) == 0 and len(shingles.shingles("a b c")) == 1
    assert (shingles.shingles("A b c d e  f") == shingles.shingles("a b c d e f")).all()
    long = " ".join(str(i % 9973) for i in range(30_000))
    assert len(shingles.shingles(long)) == 9973 and len(shingles.sketch(shingles.shingles(long))[1]) == shingles.BANDS
