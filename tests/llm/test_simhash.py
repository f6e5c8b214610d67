import random

import xxhash
from sigloom.llm import simhash

ROWS = [(1, "one two three four five"), (2, "one two three four five"), (3, None), (4, ""), (None, "alone here in the world"), (5, " \t"), (7, "a"), (7, "a"), (8, "ÀB  c"), (9, "Àb C")]


def slow(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fp = [slow(t) for _, t in rows]
    at = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 2 and at[i] > at[j]:
                    at[i], changed = at[j], True
    ids = {k: min((d for (d, _), a in zip(rows, at) if a == k and d is not None), default=None) for k in at}
    return sorted(((d, f"{f:016x}", ids[a]) for (d, _), f, a in zip(rows, fp, at)), key=str)


def test_small_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((tuple(r)[:3] for r in simhash.near_duplicates(df).collect()), key=str) == brute(ROWS)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    kept = simhash.deduplicated(df.selectExpr("*", "1 AS fp", "2 AS label", "3 AS a", "4 AS _th", "5 AS doc", "6 AS _id"))
    assert kept.columns == ["doc_id", "text", "fp", "label", "a", "_th", "doc", "_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 7, 8, None]


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r)[:3] for r in simhash.near_duplicates(df).collect()), key=str) == brute(rows)


def test_links_are_complete(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(20)]
    fps = {b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base for _ in range(20)} | set(base) | {0, 1, 2**64 - 1, 2**63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_very_long_text():
    text = " ".join(str(i % 977) for i in range(150_000))
    assert simhash.fingerprint(text) == slow(text)


def test_components_of_large_and_small_graphs(spark):
    """Chains, stars, cliques and a long path, contracted in rounds and joined at once."""
    rnd = random.Random(8)
    names = rnd.sample(range(-(10**12), 10**12), 900)
    pairs = [(names[i], names[i + 1]) for i in range(300)] + [(names[400], names[i]) for i in range(401, 500)]
    pairs += [(names[i], names[j]) for i in range(500, 512) for j in range(500, i)] + [(names[i], names[i + 1]) for i in range(600, 800, 3)]
    groups = {}
    for a, b in pairs:
        one = groups.get(a, {a}) | groups.get(b, {b})
        for x in one:
            groups[x] = one
    want = sorted((x, min(g)) for x, g in groups.items())
    df = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long").repartition(5)
    for at_once in (0, 40, 10**6):
        assert sorted(map(tuple, simhash.components(df, at_once).collect())) == want
    assert simhash.components(df.where("false")).collect() == []
