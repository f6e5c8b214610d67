import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sigloom.llm import pieces

M = pieces.load(pieces.read_model())
SP = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
ODD = ["", "a", " ", "   ", "  Hello  world\n\tx é\x00 🦜 \n\n  a", "a" * 500, "xyz" * 400, " " * 100 + "x", "的人在这里" * 50, "<s> </s> <unk> <0x0A>", "!?-_=*" * 60, "one two three " * 3000]


@pytest.mark.parametrize("text", ODD)
def test_same_ids_and_round_trip(text):
    assert list(M.encode(text)) == SP.encode(text)
    assert M.decode(M.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aehinorst \n.,ñéß中🦜ABC019_"), max_size=300))
def test_random_texts(text):
    assert list(M.encode(text)) == SP.encode(text) and M.decode(SP.encode(text)) == text


def test_commits_do_not_change_the_result(monkeypatch):
    text = pieces.SPACE + "thequickbrownfoxjumpsoverthelazydog" * 40
    whole = M.viterbi(text)
    for k in (1, 5, 40, 10_000):
        monkeypatch.setattr(pieces, "LOOK_EVERY", k)
        assert M.viterbi(text) == whole
    for w in M.cutter.findall(M.normalized("Eredhe a the, Ñandú 中 x\x00y " + "ab" * 20 + "".join(ODD[:10]))):
        assert merged(w) == M.viterbi(w)


def merged(s):
    """Ids by the merge procedure: again and again the best-scored neighbours, the leftmost of equals."""
    parts = list(s)
    while True:
        best = max(((M.score[k], -i) for i in range(len(parts) - 1) if (k := M.ids.get(parts[i] + parts[i + 1])) is not None), default=None)
        if best is None:
            return [j for p in parts for j in ([M.ids[p]] if p in M.ids else M._single(p))]
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_runs_of_no_pieces_and_long_words(monkeypatch):
    for text in ("\x01" * 5000, "a" + "\x01" * 1000 + "b" + "\x01" * 700, "ab" * 3000 + "\x02" * 400, " " * 50_000 + "end", "word" * 20_000):
        assert list(M.encode(text)) == SP.encode(text)
    monkeypatch.setattr(pieces, "LOOK_EVERY", 1)
    assert M.viterbi("\x01" * 300 + "the" + "\x01" * 300) == SP.encode("\x01" * 300 + "the" + "\x01" * 300)[1:]


def test_remembered_words_come_and_go(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    m = pieces.PieceModel(pieces.read_model())
    text = "one two three four five six seven one two eight nine ten one eleven twelve one two " * 30
    assert list(m.encode(text)) == SP.encode(text) and len(m.known) <= 5 and len(m.old) <= 5


def unigram(vocab):
    def field(n, kind, value):
        return bytes([n << 3 | kind]) + value

    def msg(n, body):
        return field(n, 2, bytes([len(body)]) + body)

    rows = [("<unk>", 0.0, 2), *((t, s, 1) for t, s in vocab.items())]
    out = b"".join(msg(1, msg(1, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for t, s, k in rows)
    return out + msg(2, field(3, 0, b"\x01")) + msg(3, field(3, 0, b"\x00") + field(4, 0, b"\x00"))


def test_unigram_against_all_segmentations(monkeypatch):
    import random

    vocab = {"a": -3.0, "b": -3.1, "ab": -4.0, "aba": -4.7, "bb": -5.5, "▁": -2.0, "▁a": -3.5, "abab": -7.1}
    m, rnd = pieces.PieceModel(unigram(vocab)), random.Random(2)
    monkeypatch.setattr(pieces, "LOOK_EVERY", 2)

    def best(s):
        at = [0.0]
        for i in range(1, len(s) + 1):
            at.append(max(at[j] + vocab[s[j:i]] for j in range(i) if s[j:i] in vocab))
        return at[-1]

    for _ in range(200):
        s = "".join(rnd.choice("aab▁") for _ in range(rnd.randint(1, 60)))
        ids = m.viterbi(s)
        assert "".join(m.text[i] for i in ids) == s and sum(m.score[i] for i in ids) == pytest.approx(best(s), abs=1e-3)


def test_query(spark):
    df = spark.createDataFrame([(1, None, [1]), (None, "", [2]), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, ids array<int>")
    got = [tuple(r) for r in pieces.tokenized(df).collect()]
    assert got == [(1, None, 0, None), (None, [], 0, True), (2, SP.encode("a b"), 2, True), (2, SP.encode("a b"), 2, True)]
    assert pieces.tokenized(df.limit(0)).collect() == []
    back = df.select(pieces.decoded(pieces.read_model(), "ids").alias("t"))
    assert [r.t for r in back.collect()] == [SP.decode([1]), SP.decode([2]), None, None]


def test_all_documents_round_trip(spark, sf):
    rows = pieces.tokenized(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(r.exact and r.ids == SP.encode(r.text) for r in rows)
