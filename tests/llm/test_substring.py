import random
import re

from millrace.llm import substring
from tests.llm.helpers import prose, word


def brute(rows):
    """Texts without the sentences of non-first repeated runs."""
    seen, out, todo = set(), {}, []
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        tiles = substring.tiles_of(text or "")
        norm = [(i, " ".join(re.findall(r"[^\W_]+", t.lower()))) for i, t in enumerate(tiles)]
        norm = [(i, n) for i, n in norm if n]
        gone = set()
        for (i, a), (j, b) in zip(norm, norm[1:]):
            if len(a.split()) + len(b.split()) >= substring.MIN_WORDS or len(a) + len(b) >= substring.MIN_CHARS:
                if (a, b) in seen:
                    gone |= {i, j}
                seen.add((a, b))
        out[key, text] = (text if not gone else "".join(t for i, t in enumerate(tiles) if i not in gone), len(gone))
    return out


def test_against_brute_force(spark):
    draw = random.Random(1)
    passages = [prose(draw, 60) for _ in range(4)]
    rows = [(None, prose(draw)), (1, None), (2, ""), (3, "one. two."), (4, "?!.\n\n...")]
    for i in range(5, 60):
        parts = [prose(draw, draw.randint(5, 60)) for _ in range(draw.randint(0, 3))]
        if draw.random() < 0.6:
            parts.insert(draw.randint(0, len(parts)), draw.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(60, rows[10][1]), (10, rows[10][1]), (61, "x " * 30_000 + ". " + passages[0])]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, h string, tiles int")
    out = substring.remove_repeated(docs).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    assert sorted(map(repr, [(r.doc_id, r.text, r.n_removed) for r in out])) == sorted(repr((k, *want[k, t])) for k, t in rows)
    assert sum(r.n_removed for r in out) > 50
    assert substring.remove_repeated(docs.filter("doc_id < 0")).collect() == []


def test_long_sentences_and_scripts_without_spaces(spark):
    draw = random.Random(2)
    long = " ".join(f"{word(draw)}{',' if i % 9 == 8 else ''}" for i in range(90))
    han = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(60)) + "。" + "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(40)) + "。"
    rows = [(1, long), (2, long), (3, han), (4, "前言在此。" + han), (5, " ".join(word(draw) for _ in range(90)))]
    out = {r.doc_id: r for r in substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {k: (r.text, r.n_removed) for k, r in out.items()} == {k: want[k, t] for k, t in rows}
    assert out[1].n_removed == out[3].n_removed == out[5].n_removed == 0
    assert out[2].text == "" and out[4].text == "前言在此。"
    assert all("".join(substring.tiles_of(t)) == t for _, t in rows)
