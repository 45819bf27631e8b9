"""Packing: places, counts against an exact packing bin by bin, token ids against the tokenizer, odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from voxelloom.llm import packing
from voxelloom.llm.tokens import ChunkEncoder, word_bpe


def one_by_one(lengths, size):
    """The same method, bin by bin."""
    left, bins = Counter(lengths), []
    while +left:
        bin_, gap = Counter(), size
        while fits := [x for x in +left if x <= gap]:
            bin_[max(fits)] += 1
            left[max(fits)] -= 1
            gap -= max(fits)
        smallest = min(bin_)
        pairs = [(a, b) for a in +left for b in +left if a <= b and (a < b or left[a] > 1) and smallest < a + b <= gap + smallest]
        if gap and pairs:
            a, b = max(pairs, key=lambda p: (sum(p), -p[0]))
            left.update({smallest: 1})
            left.subtract([a, b])
            bin_.subtract({smallest: 1})
            bin_.update([a, b])
        bins.append(+bin_)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_layouts_equal_packing_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
    found = [tuple(sorted(b.items())) for b, n in packing.layouts(Counter(lengths), 60) for _ in range(n)]
    assert Counter(found) == Counter(tuple(sorted(b.items())) for b in one_by_one(lengths, 60))


def test_replacement_closes_a_gap():
    # greedily 6 + 3 leaves a gap of 1; 3 gives way to 2 + 2
    found = packing.layouts({6: 1, 3: 1, 2: 2}, 10)
    assert found[0] == (Counter({6: 1, 2: 2}), 1)


def check(packed, size):
    rows = packed.toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id")["length"].cumsum()
    assert (ends - rows["length"] == rows["offset"]).all() and (ends <= size).all()
    return rows


def test_places_are_gapless_and_few(spark):
    rng = random.Random(3)
    lengths = [rng.choice([64, 64, 64, rng.randint(1, 63)]) for _ in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = check(packing.pack(pieces, 64), 64)
    assert len(rows) == 3000 and rows["sequence_id"].nunique() <= 1.005 * sum(lengths) / 64


def test_ids_are_those_of_the_tokenizer(spark, odd):
    plain = Tokenizer.from_file(word_bpe())
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    packed = packing.pack_documents(odd, 2048, with_ids=True)
    rows = check(packed, 2048)
    assert list(rows.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    want = Counter()
    for key, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for number in range(-(-len(ids) // 2048)):
            part = ids[2048 * number : 2048 * (number + 1)]
            want[(key, number, 2048 * number, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want
    whole = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(packed).collect()}
    for number, part in rows.groupby("sequence_id"):
        assert whole[number] == [i for ids in part["ids"] for i in ids]


def test_empty_table(empty):
    assert packing.pack_documents(empty).count() == 0


def test_chunks_are_encoded_like_whole_texts():
    rng = random.Random(1)
    letters = "aZé'.,! \n\t3½_ΣİßÁ-日 sTlLrE\x1ć"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["it's I'LL <|endoftext|>", "x́ ²³ ǅ ﬁ"]
    encode = ChunkEncoder(word_bpe())
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]
        assert got == [x.ids for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_are_remembered_once(monkeypatch):
    """Words and chunks share one bounded memory, and ids stay those of the tokenizer when it is full."""
    monkeypatch.setattr("voxelloom.llm.tokens.REMEMBERED", 300)
    encode = ChunkEncoder(word_bpe())
    names = ["".join(chr(97 + n // 26**k % 26) for k in range(3)) for n in range(1200)]
    texts = [" ".join(f"{a} {a.title()}, {a}\x00 x{n}²" for a in names[n : n + 4]) for n in range(0, 1200, 4)] + ["\xad a\xad, É,é É", "\x1c, b"]
    for text in texts * 2:
        expected = np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encode([text]) == [expected]
    assert sum(len(x) for x in vars(encode).values() if isinstance(x, dict)) < 300 + 30
