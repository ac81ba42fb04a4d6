import random

import numpy as np
import pytest

from sieveworks.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.read()


@pytest.fixture(scope="module")
def texts(prose):
    rng = random.Random(5)
    return [prose(60, 1), "Hello  world", " lead and trail ", "größe 日本語 \U0001f1e9\U0001f1ea é", "\n\t\r\n", "a" * 3000, "x   y", "<s> </s> <0x41> <unk>", *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000)])) for _ in range(80)).replace(sp.MARK, "x") for _ in range(30))]


def test_trie(vocabulary):
    trie = vocabulary.trie
    for i in range(300, 32000, 97):
        node = 0
        for byte in vocabulary.pieces[i]:
            at = trie.base[node] + byte + 1
            assert trie.check[at] == node
            node = at
        assert trie.value[node] == i


def test_best_path_against_all_cuts(vocabulary):
    """The plain quadratic recurrence, without a trie."""
    score = {p: s for p, s in zip(vocabulary.pieces[259:], vocabulary.scores[259:], strict=True)}
    unknown = vocabulary.scores[vocabulary.byte_ids[0]]
    for word in ("▁therefore", "▁Größenordnung", "▁日本語", "▁a1b2", "▁▁▁x"):
        best = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                part = word[i:j].encode()
                gain = score.get(part, unknown if j == i + 1 else -np.inf)
                best[j] = max(best[j], best[i] + gain)
        ids, at, total = vocabulary.best(word), 0, 0.0
        raw = word.encode()
        while at < len(ids):
            if ids[at] in vocabulary.byte_ids:
                width = next(w for w in range(1, 5) if at + w == len(ids) or ids[at + w] not in vocabulary.byte_ids or (raw[len(b"".join(vocabulary.pieces[i] for i in ids[: at + w]))] & 0xC0) != 0x80)
                at, total = at + width, total + unknown
            else:
                total += vocabulary.scores[ids[at]]
                at += 1
        assert total == pytest.approx(best[-1]) and b"".join(vocabulary.pieces[i] for i in ids) == raw


def test_against_the_library(vocabulary, texts):
    """The public library runs the same pieces and scores as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(sp.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, piece in enumerate(model.pieces):
        if piece.type == pb.ModelProto.SentencePiece.NORMAL:
            piece.score = vocabulary.scores[i]
    other, encoder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), sp.Encoder(vocabulary)
    scores = np.array(vocabulary.scores)
    for text in texts:
        mine, theirs = encoder.encode([text])[0].tolist(), other.encode(text)
        if mine != theirs:  # equal but for rounding in single precision
            assert scores[mine].sum() >= scores[theirs].sum() - 1e-3
        assert other.decode(mine) == vocabulary.decode(mine)


def test_round_trip(spark, frame, texts):
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "a▁b"), (None, "n"), (0, texts[0])]
    out = sp.encode(frame(rows, extra=True))
    found = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows) and all(found[k]["lossless"] for k in range(len(texts))) and found[100]["ids"] == [] and not found[102]["lossless"]
    back = {r["doc_id"]: r["decoded"] for r in sp.decode(out).collect()}
    assert all(back[k] == t for k, t in enumerate(texts)) and back[100] == back[101] == "" and back[102] == "a b"
    assert sp.encode(frame([])).count() == 0


def test_words_side_by_side_have_the_paths_of_words_alone():
    vocabulary, rng = sp.Vocabulary.read(), random.Random(5)
    letters = "abcdefghij klmnop▁éßñ漢😀\x00\n.,0"
    words = {"▁" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 14))).replace(" ", "") for _ in range(3000)} | {"▁", "a", "😀"}
    words = [w for w in words if len(w.encode()) <= sp.SIDE_BY_SIDE]
    assert [np.frombuffer(p, "<i4").tolist() for p in vocabulary.best_of_many([w.encode() for w in words])] == [vocabulary.best(w) for w in words]


def test_long_words_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(sp, "KEPT_WORDS", 5)
    monkeypatch.setattr(sp, "BLOCK_BYTES", 8)
    vocabulary = sp.Vocabulary.read()
    encoder, texts = sp.Encoder(vocabulary), ["one two three four five six seven", "x" * 500 + " one", "", "one nine " + "é" * 90, " "]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == ([] if not text else vocabulary.best("▁" + text.replace(" ", "▁")))
