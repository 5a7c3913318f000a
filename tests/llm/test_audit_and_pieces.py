import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import filter_audit, pieces

from .conftest import SCHEMA, found

# Filter interaction audit


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def brute_audit(rows, labels):
    """Every order applied step by step to every row."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    told = []
    for i, text, lang in rows:
        fails = failing(text or "")
        same = [j for j, t, _ in rows if (t or "") == (text or "") and j is not None]
        fails["E"] = bool(same) if i is None else min(same) < i
        told.append((i, lang or "", {f for f, bad in fails.items() if bad}))
    out, total = [], {}
    for part, order in itertools.product({p for _, p, _ in told}, itertools.permutations("ABCDE")):
        left = [(i, f) for i, p, f in told if p == part]
        every = list(left)
        for step, letter in enumerate(order):
            removed = [i for i, f in left if letter in f]
            left = [(i, f) for i, f in left if letter not in f]
            fail = [f for _, f in every if letter in f]
            total[part, letter] = total.get((part, letter), 0) + len(removed)
            out.append([part, "".join(order), step + 1, len(left), len(removed), len(fail) - len(removed), sum(f == {letter} for f in fail), sum(i in good for i in removed), sum(i in toxic for i in removed), letter])
    return sorted((tuple(r[:-1]) + (total[r[0], r[-1]],) for r in out), key=repr)


def audit_rows(rows):
    rng = random.Random(4)
    own = [(i, t, lang) for i, t, lang, *_ in rows]
    own += [(400 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([90, 100, 130]))) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 8]), rng.choice(["en", "", None])) for k in range(60)]
    return own + [(1000 - i, t, "fr") for i, t, _ in own[-12:]]


LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (101, 1, 1), (400, 1, 0), (401, None, 1), (None, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize("bits", [64, 1, 0])
def test_audit(spark, rows, bits):
    """With few bits, classes hold different texts of one length, which must be told apart by the texts."""
    own = audit_rows(rows)
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "'x' as part", "2 as least", "3 as n_texts", "4 as h0")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert found(filter_audit.interactions(filter_audit.masks(docs, bits), labels)) == brute_audit(own, LABELS)


def test_audit_of_hot_text_and_long_texts(spark):
    """A text in two thirds of all rows; long texts that differ in their last code point only."""
    rows = [(i, "the same " * 30, "en") for i in range(600)] + [(1000 + i, "é" * 300_000 + str(i % 3), "de") for i in range(6)]
    masked = filter_audit.masks(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    copies = {r.doc_id for r in masked.collect() if r.mask & filter_audit.COPY_BIT}
    assert copies == set(range(1, 600)) | {1003, 1004, 1005}


def test_audit_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(filter_audit.interactions(filter_audit.masks(nothing), labels)) == []
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    rows = found(filter_audit.interactions(filter_audit.masks(one), labels))
    assert len(rows) == 600 and sum(r[4] for r in rows) == 120


# SentencePiece

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
PARTS = ["a", "the ", " ", "  ", "\t", "\n", "é", "ﬁ", "½", "　", "¨", "日本", "🙂", "​", "\x00", "\x07", "▁", "<s>", "<0x0A>", "ｶﾞ", "é", "가", "word", "‗", "ﷺ", "Ａ", " ", "\r\n"]


def model_with(rule, changes):
    """The vocabulary of the given model with another of the library's own character maps."""
    spec = next(v for n, v in pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == pieces.NORMALIZER)
    spec = dict(pieces.fields(spec)) | changes
    return pieces.message([(n, v) for n, v in pieces.fields(MODEL) if n != pieces.NORMALIZER] + [(pieces.NORMALIZER, pieces.message([(n, v) for n, v in spec.items() if v != b""]))])


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("changes", [{}, {pieces.REMOVE_SPACES: 0}, {pieces.DUMMY_PREFIX: 0}], ids=str)
def test_ids_and_spans_are_the_librarys(rule, changes):
    model, rng = model_with(rule, changes), random.Random(6)
    own, library = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefgh日éx") for _ in range(700)) for _ in range(5)] + ["", " ", "▁", "x" * 3000]
    for text in texts:
        ids, begins, ends = (x.tolist() for x in own.encode(text))
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert list(zip(ids, begins, ends, strict=True))[1:-1] == [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces], text


def test_parts_are_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "SOME_PARTS", 20)
    own, rng = pieces.Pieces(MODEL), random.Random(7)
    for _ in range(30):
        text = " ".join(str(rng.randrange(10**6)) for _ in range(60))
        assert list(own.encode(text))[0].tolist() == own.library.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused():
    spec = dict(pieces.fields(next(v for n, v in pieces.fields(MODEL) if n == pieces.TRAINER)))
    for changes in ({pieces.MODEL_TYPE: 1}, {pieces.BYTE_FALLBACK: 0}, {pieces.SPACE_AS_SUFFIX: 1}):
        trainer = [(n, v) for n, v in (spec | changes).items() if not isinstance(v, bytes)]
        with pytest.raises(ValueError, match="only BPE"):
            pieces.Pieces(pieces.message([(n, v) for n, v in pieces.fields(MODEL) if n != pieces.TRAINER] + [(pieces.TRAINER, pieces.message(trainer))]))


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_pieces(spark, docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode())))
    got = pieces.encoded_digests(docs)
    assert found(got.drop("spans_sha256")) == sorted(want, key=repr)
    encoded = pieces.encode(docs, model := pieces.shared_model(spark))
    texts = {i: t or "" for i, t, *_ in rows if i is not None}
    for r in encoded.filter("doc_id is not null").collect():
        data = texts[r.doc_id].encode()
        assert b"".join(data[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == data
    assert {r.doc_id: r.text for r in pieces.decode(encoded, model).filter("doc_id is not null").collect()} == texts


def test_pieces_of_nothing_and_of_a_very_long_text(spark, nothing):
    assert found(pieces.encoded_digests(nothing)) == []
    library, rng = sentencepiece.SentencePieceProcessor(model_proto=MODEL), random.Random(8)
    rows = [(1, " ".join(str(rng.randrange(10**9)) for _ in range(300_000)), None, None, None), (2, "ab" * 500_000, None, None, None), (3, None, None, None, None)]
    for r in pieces.encode(spark.createDataFrame(rows, SCHEMA), pieces.shared_model(spark)).collect():
        assert r.ids == library.encode(rows[r.doc_id - 1][1] or "", add_bos=True, add_eos=True)
        assert r.ends[-1] == len(rows[r.doc_id - 1][1] or "")
