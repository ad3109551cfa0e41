import math
import random
from collections import Counter

from millrace.llm import decontam
from tests.llm.helpers import prose, word


def brute(rows, items):
    """Every passage against every part, by the plain formula."""
    texts = {i: t for i, t in items if decontam.words_of(t)}
    parts = [(i, decontam.words_of(t)[lo : lo + 64]) for i, t in texts.items() for lo in range(0, len(decontam.words_of(t)), 64)]
    df = Counter(w for _, p in parts for w in set(p))
    mean = sum(len(p) for _, p in parts) / max(1, len(parts))
    out = set()
    for key, text in rows:
        words = decontam.words_of(text)
        for lo in range(0, max(1, len(words) - 64), 64) if words else ():
            passage = set(words[lo : lo + 128])
            for i, p in parts:
                weight = {w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(p) / mean)) for w, n in Counter(p).items()}
                if sum(x for w, x in weight.items() if w in passage) >= 0.6 * sum(weight.values()) - 1e-9:
                    n = len(decontam.words_of(texts[i]))
                    region = words[max(0, lo - n) : lo + 128 + n]
                    q, a = decontam.question_answer(texts[i])
                    if decontam.overlap(q, region) >= 0.8 and decontam.overlap(a, region) >= 0.8:
                        out.add((key, i))
    return out


def test_against_brute_force(spark):
    draw = random.Random(9)
    vocabulary = [word(draw, (2, 5)) for _ in range(300)]
    items = [(i, prose(draw, draw.randint(6, 40), vocabulary)) for i in range(60)] + [(60, prose(draw, 200, vocabulary)), (61, None), (62, ""), (63, "two words"), (64, "...")]
    items.append(items[3])
    rows = [(None, items[4][1]), (1, None), (2, ""), (3, "..."), (4, "x " * 30_000 + items[5][1])]
    for i in range(5, 120):
        parts = [prose(draw, draw.randint(5, 200), vocabulary) for _ in range(2)]
        kind = draw.random()
        if kind < 0.3:
            parts.insert(1, draw.choice(items[:61])[1].upper())
        elif kind < 0.6:
            words = draw.choice(items[:61])[1].split()
            for _ in range(draw.randint(1, 4)):
                words[draw.randrange(len(words))] = word(draw)
            parts.insert(1, " ".join(words))
        rows.append((i, " ".join(parts)))
    rows.append(rows[50])
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_matches(docs, bench).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in out} == want and len(want) > 30
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in clean.collect()))) == sorted(repr(k) for k, _ in rows if k not in {d for d, _ in want})
    assert decontam.find_matches(docs, bench.filter("item_id < 0")).collect() == []
    assert decontam.find_matches(docs.filter("doc_id < 0"), bench).collect() == []


def test_shards_give_the_same(spark, monkeypatch):
    draw = random.Random(10)
    items = [(i, prose(draw, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, prose(draw, 40) + " " + items[i][1]) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontam.find_matches(docs, bench).collect())
    monkeypatch.setattr(decontam, "SHARD", 7)
    assert sorted(decontam.find_matches(docs, bench).collect()) == whole and len(whole) == 30
