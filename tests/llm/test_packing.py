import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm.packing import OpenBins, best_fit_runs, pack
from vitrine.llm.tokens import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", "'", "don't it's I'LL we've", "a  b\n\nc \t d ", " lead", "x½y m²x Ⅷ", "don'tis 'tis", "naïve Café É́x", "a_b __x__ c--d!!", "１２ ٣٤٥", "ΣΑΣ İx", "foo\x1cbar", " nb sp x",
    "éa", "<|endoftext|> hi", "Hello,World (x) y.z...", "emoji 😀😀 ok😀", "a​b", "  ", " ", "\n", "a ", "it's!", "ab.\nCd ef\n\ngh i\n j k.\nl\nm\n", "\nx y", "x\n", " a\nb c", "a \nb",
]


@pytest.mark.parametrize("name", FILES)
def test_chunks_give_the_ids_of_whole_texts(name):
    r = random.Random(1)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    enc = Encoder(public_tokenizers.path(name), size=50)
    alphabet = ["a", "Bc", "don't", "é", "!", "..", ",", " ", "  ", "\n", "\t", "1", "22", "word", "_", "'s", "漢字", " ", "ß"]
    for text in ODD + ["".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(400)]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids, repr(text)


def one_by_one(lengths, capacity):
    """Best-fit decreasing, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_runs_are_best_fit_decreasing():
    r = random.Random(2)
    for capacity in (10, 37, 64):
        for _ in range(60):
            lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            runs, bins = best_fit_runs(histogram, capacity)
            fill = {}
            for length, rank, count, first, offset in runs:
                for k in range(count):
                    fill.setdefault(first + k, []).append((offset, length))
            for places in fill.values():
                places.sort()
                assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
            assert sorted(capacity - sum(n for _, n in p) for p in fill.values()) == one_by_one(lengths, capacity)
            assert len(fill) == bins
            for n, c in histogram.items():
                assert sorted(x for length, rank, count, _, _ in runs if length == n for x in range(rank, rank + count)) == list(range(c))


def test_segment_tree():
    r, bins, plain = random.Random(4), OpenBins(50), {}
    for _ in range(600):
        room = r.randint(1, 50)
        if r.random() < 0.6:
            bins.add(room, 0, 1)
            plain[room] = plain.get(room, 0) + 1
        elif plain.get(room):
            bins.pop(room)
            plain[room] -= 1
        need = r.randint(1, 50)
        assert bins.tightest(need) == min((k for k, n in plain.items() if n and k >= need), default=None)


def test_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path(FILES[0])
    whole = Tokenizer.from_file(path)
    rows = pack(odd_docs, path, capacity=64, with_ids=True).collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r["doc_id"], k, lo, len(ids[lo : lo + 64]), zlib.crc32(ids[lo : lo + 64].tobytes())) for k, lo in enumerate(range(0, len(ids), 64))]
    key = lambda x: tuple((v is None, v) for v in x)
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 64
    assert len(by) == len(one_by_one([w[3] for w in want], 64))
    assert pack(no_docs, path).collect() == []
