"""The audit of filters against documents filtered one by one."""

import re
from collections import Counter
from itertools import permutations

from sigloom.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, mask string, n_chars long"
LABELS = "doc_id long, quality int, toxic int, part string"
LONG = " ".join(f"w{i}" for i in range(250))


def failing(docs):
    """For each row its set of failing filters, word by word and letter by letter."""
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, *_ in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        bad |= {"E"} if d is not None and d > least[t] else set()
        out.append(bad)
    return out


def by_hand(docs, labels):
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x, *_ in labels if x == 1 and d is not None}
    bad, out, shapley = failing(docs), {}, Counter()
    for part in {s or "" for _, _, s, *_ in docs}:
        rows = [(d, b) for (d, _, s, *_), b in zip(docs, bad, strict=True) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                redundant = sum(f in b for _, b in rows) - len(gone)
                alive = [r for r in alive if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(alive), len(gone), redundant, sum(b == {f} for _, b in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(spark, docs, labels):
    rows = filter_audit.audit(filter_audit.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}, len(rows)


def test_against_documents_filtered_one_by_one(spark):
    texts = [None, "", "short", LONG, LONG.upper(), LONG + " #", "x " * 400, LONG.replace(" ", "  \x0b\t"), "Ä" * 100 + " " + LONG, "w " * 100_000 + " ".join(map(str, range(120_000)))]
    docs = [(i, texts[i % len(texts)], ["hot", None, "", "a"][i % 4 if i % 3 else 0], "clash", "clash", 1) for i in range(60)]
    docs += [(None, LONG, "a", "x", "x", 1), (None, LONG, "hot", "x", "x", 1), (3, LONG, "hot", "x", "x", 1), (3, LONG, "hot", "x", "x", 1), (70, "lone text", "b", "x", "x", 1)]
    labels = [(i, i % 2, int(i % 5 == 0), "p") for i in range(0, 60, 2)] + [(1, None, None, "p"), (None, 1, 1, "p"), (4, 1, 0, "p"), (4, 0, 1, "p")]
    got, n = audited(spark, docs, labels)
    want = by_hand(docs, labels)
    assert n == len(want) == 600 * 4  # the null source and the empty one are one part
    assert got == want


def test_empty_tables(spark):
    assert audited(spark, [], []) == ({}, 0)
    got, n = audited(spark, [(1, LONG, "a", "", "", 0)], [])
    assert n == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}
