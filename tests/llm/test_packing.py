import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parchmint.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizers():
    return packing.WordTokenizer(PATH, cache_words=50), Tokenizer.from_file(PATH)


ODD = [
    "", "  ", "a..b.,c '.s don't. we'll, ÀÉ. İstanbul ΣΑΣ. x<|endoftext|>y. <|startoftext|>", "ét́. 5. 55, ½. ²,", "a\x1cb\x1f.",
    "l's. 'll. 's, ª. µ. ß.", "\x85x\xa0y.", "a​b", "".join(map(chr, range(1, 600))), "日本語 テキスト",
]


def test_words_give_the_ids_of_the_text(tokenizers):
    own, whole = tokenizers
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices("ab.,' éÉ\n1*|É’", k=400)) for _ in range(20)] + ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(300)) for _ in range(10)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5, 5, 5], [4096 * 3 + 7, 1, 4095, 2000, 3000] * 7, [4095] * 50, "random"])
def test_assign(lengths):
    lengths = [random.Random(4).randrange(1, 9000) for _ in range(700)] if lengths == "random" else lengths
    pieces, n = packing.assign(lengths)
    check_pieces([(d, s, k, q, o) for d, s, k, q, o in pieces], dict(enumerate(lengths)))
    assert {p[3] for p in pieces} == set(range(n))


def check_pieces(pieces, lengths):
    documents, sequences = {}, {}
    for d, start, length, s, offset in pieces:
        documents.setdefault(d, []).append((start, length))
        sequences.setdefault(s, []).append((offset, length))
    for spans, total in [(documents.get(d, []), n) for d, n in lengths.items()] + [(s, None) for s in sequences.values()]:
        end = 0
        for at, length in sorted(spans):
            assert at == end and length > 0
            end += length
        if total is not None:
            assert end == total
        else:
            # Full, or of a length that isn't padded.
            assert end == 4096 or (end < 4096 and end & (end - 1) == 0)


def test_balance():
    """Quadratic cost is more even than in first-fit order."""
    lengths = [random.Random(6).choice([40, 200, 900, 2500]) for _ in range(900)]
    pieces, n = packing.assign(lengths)
    costs = np.zeros(n)
    full = np.zeros(n)
    for _, _, length, s, _ in pieces:
        costs[s] += packing.cost(length)
        full[s] += length
    costs = costs[full == 4096]
    plain, room, own = [0.0], 4096, lengths
    for length in own:
        while length:
            k = min(length, room)
            plain[-1] += packing.cost(k)
            length, room = length - k, room - k
            if not room:
                plain.append(0.0)
                room = 4096
    assert costs.std() < np.array(plain[:-1]).std()


def rows_of(df):
    return [(r.start, r.length, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset, r.doc_id) for r in df.collect()]


def test_pack(make, odd, none, tokenizers):
    _, whole = tokenizers
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["alpha", "be", "gamma,", "D."], k=rng.randrange(6000))) for _ in range(60)] + [None, ""]
    rows = rows_of(packing.pack(make(enumerate(texts)), PATH, block_tokens=30_000))
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    check_pieces([(r[6], r[0], r[1], r[4], r[5]) for r in rows], {i: len(x) for i, x in want.items()})
    for start, length, ids, total, _, _, d in rows:
        assert np.frombuffer(ids, "<u4").tolist() == want[d][start : start + length] and total == len(want[d])
    assert rows_of(packing.pack(none, PATH)) == []
    found = rows_of(packing.pack(odd, PATH))
    assert {r[6] for r in found} == {1, 2, 3, 4, 5, 6, None}
    # Null and blank texts are their end token alone.
    assert [(r[1], np.frombuffer(r[2], "<u4").tolist()) for r in found if r[6] in (2, 3, 4)] == [(1, [2])] * 3


def test_query(spark, make, tmp_path):
    from parchmint.llm.queries import queries

    make([(7, "hello world"), (8, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["op6_cost_balanced_packing"](spark, str(tmp_path)).collect()
    ids = np.array([*Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids, 2], "<u4").tobytes()
    pieces = {r.doc_id: r for r in rows if r.start == 0}
    assert pieces[8].ids_crc32 == zlib.crc32(b"\x02\0\0\0") and pieces[8].doc_tokens == 1
    assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in rows if r.doc_id == 7)
