import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import packing


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_equals_best_fit_over_single_pieces():
    draw = random.Random(3)
    for _ in range(60):
        capacity = draw.choice([7, 16, 50])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 80))]
        counts = Counter(lengths)
        rows = packing.plan(counts, capacity)
        filled = defaultdict(list)
        for length, first, n, each, sequence, offset in rows:
            for k in range(n):
                filled[sequence + k // each].append((offset + k % each * length, length))
        assert Counter(x for f in filled.values() for _, x in f) == counts
        for f in filled.values():
            at = 0
            for offset, length in sorted(f):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(filled) == best_fit(lengths, capacity)


def test_encoders_agree():
    encoder = packing.Encoder.of(*packing.default_paths())
    draw = random.Random(5)
    letters = "aeiou tnß éñ'\n\t.,!?0123#&%|$-  Ǻĺ" + "  中😀"
    for _ in range(400):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 200)))
        assert encoder.ids(text) == encoder.slow.encode(text, add_special_tokens=False).ids
    for text in ("a<|endoftext|> b", "x" * 3000, " " * 3000, "don't I'LL they've"):
        assert encoder.ids(text) == encoder.slow.encode(text, add_special_tokens=False).ids


def test_packing_whole(spark):
    draw = random.Random(7)
    texts = [None, "", "one", "one"] + [" ".join(draw.choice(["alpha", "be", "\n", "gamma9"]) for _ in range(draw.randint(0, 2500))) for _ in range(60)]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int")
    out = packing.pack_digest(docs).collect()
    slow = packing.Encoder.of(*packing.default_paths()).slow
    whole = defaultdict(list)
    for r in out:
        whole[r.sequence_id].append((r.offset, r.length))
    for f in whole.values():
        at = 0
        for offset, length in sorted(f):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(whole) == best_fit([r.length for r in out], 1024)
    want = Counter()
    for key, text, *_ in rows:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    ids = packing.pack(docs).filter("doc_id = 2").collect()
    assert np.frombuffer(ids[0].ids, "<u4").tolist() == [*slow.encode("one").ids, 2]
    assert packing.pack_digest(docs.filter("doc_id < 0")).collect() == []
