import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sigloom.llm import packing


def plain_best_fit(sizes, capacity):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [k for k in range(len(rows)) if room[k] >= sizes[i]]
        if fits:
            k = min(fits, key=lambda k: room[k])
            rows[k].append(i)
            room[k] -= sizes[i]
        else:
            rows.append([i])
            room.append(capacity - sizes[i])
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_as_full_as_plain_best_fit(sizes):
    got, want = packing.best_fit_decreasing(sizes, 40), plain_best_fit(sizes, 40)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 40 for r in got)
    assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(sum(sizes[i] for i in r) for r in want)


def restored(rows):
    docs = {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] and r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[0] == 0
        for d, at, lo, hi in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            docs.setdefault(d, []).append((at, ids[lo:hi]))
    out = {}
    for d, parts in docs.items():
        parts.sort(key=lambda p: p[0])
        assert [at for at, _ in parts] == [0, *np.cumsum([len(p) for _, p in parts])[:-1].tolist()]
        out[d] = np.concatenate([p for _, p in parts])
    return out


@pytest.mark.parametrize("shard", [500, 4_000_000])
def test_lossless(spark, sf, shard):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    enc = packing._encoding(open(packing.RANKS, "rb").read(), packing.PATTERN)
    rows = packing.packed(df, row=256, shard_tokens=shard).collect()
    assert all(r.n_tokens <= 256 for r in rows) and len({(r.shard, r.row) for r in rows}) == len(rows)
    docs = restored(rows)
    for r in df.collect():
        assert docs[r.doc_id][-1] == packing.END_ID and enc.decode(docs[r.doc_id][:-1].tolist()) == r.text
    if shard > 500:
        assert sum(r.n_tokens for r in rows) / (256 * len(rows)) > 0.95


def test_odd_rows_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "word " * 100_000, 7)], "doc_id long, text string, row int")
    rows = packing.packed(df)
    docs = restored(rows.collect())
    assert docs[1].tolist() == docs[2].tolist() == [packing.END_ID] and len(docs[None]) > 100_000
    assert packing.packed(df.limit(0)).collect() == []
    back = packing.write_matrices(rows, str(tmp_path / "m")).collect()
    assert all(len(r.ids) == 2 * packing.ROW and np.frombuffer(r.ids, "<u2")[r.n_tokens :].tolist() == [packing.END_ID] * (packing.ROW - r.n_tokens) for r in back)
    both = packing.packed(spark.createDataFrame([(1, "a b c", 0)] * 3, "doc_id long, text string, x int").coalesce(1)).collect()
    assert len(both) == 1 and both[0].doc_ids == [1, 1, 1]


def test_rooms_against_a_list():
    rnd = random.Random(3)
    rooms, held = packing.Rooms(50), []
    for k in range(3000):
        if rnd.random() < 0.5:
            held.append(size := rnd.randint(0, 50))
            rooms.put(size, k)
        else:
            need = rnd.randint(0, 50)
            want = min((s for s in held if s >= need), default=None)
            got = rooms.take(need)
            assert (got[0] if got else None) == want
            if got:
                held.remove(want)


def test_long_runs_of_white_space_keep_their_ids():
    enc = packing._encoding(open(packing.RANKS, "rb").read(), packing.PATTERN)
    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "Wort ", "'s", "7", "!", "  ", " \n ", "\u3000\u2003 ", "\t" * 9, "\x1f\x1f\x1f", " " * 12, "é"]) for _ in range(rnd.randrange(1, 30)))
        assert packing.encode(enc, text, long_run=3) == enc.encode_ordinary(text), repr(text)
    for run in (" " * 300_000, "\n" * 300_000, " \t" * 150_000):  # below what the encoder can take itself
        for text in (run, "x" + run, run + "x", "a" + run + "!", run + "'s" + run):
            assert packing.encode(enc, text) == enc.encode_ordinary(text)


def test_a_million_spaces(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "end", "a" + " " * 3_000_000 + "b", "word" * 500_000]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    enc = packing._encoding(open(packing.RANKS, "rb").read(), packing.PATTERN)
    docs = restored(rows)
    assert all(enc.decode(docs[i][:-1].tolist()) == t for i, t in enumerate(texts))
