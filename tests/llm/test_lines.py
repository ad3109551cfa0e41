import random
from collections import Counter

from millrace.llm import lines
from tests.llm.helpers import word


def brute(rows):
    """Lines that are like an earlier one, kept or not, go."""
    seen, out = [], {}
    for key, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in text.split("\n"):
            tokens = frozenset(w for w in line.lower().split(" ") if w)
            if len(tokens) >= lines.LEAST:
                if any(5 * len(tokens & t) >= 4 * len(tokens | t) for t in seen):
                    seen.append(tokens)
                    continue
                seen.append(tokens)
            kept.append(line)
        out[key, text] = "\n".join(kept), text.count("\n") + 1 - len(kept)
    return out


def fixture(draw):
    vocabulary = [word(draw, (1, 6)) for _ in range(400)]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    bases = [line(draw.randint(5, 40)) for _ in range(12)]

    def some():
        kind = draw.random()
        if kind < 0.4:
            return line(draw.randint(0, 30))
        words = draw.choice(bases).split()
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return " ".join(words).upper() if kind < 0.5 else " ".join(words)

    rows = [(None, some() + "\n" + some()), (1, None), (2, ""), (3, "\n\n"), (4, "short line"), (5, line(5000)), (6, line(20) + "\t" + line(5))]
    return rows + [(i, "\n".join(some() for _ in range(draw.randint(1, 6)))) for i in range(7, 120)]


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, 3, 1) for k, t in rows], "doc_id long, text string, n_removed int, _gone int").drop("_gone")
    out = lines.dedup_lines(docs).collect()
    want = brute(rows)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in out) == Counter((k, *(want[k, t] if t is not None else (None, 0))) for k, t in rows)


def test_against_brute_force(spark):
    rows = fixture(random.Random(11))
    check(spark, [*rows, rows[20], rows[5]])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).collect() == []


def test_hot_families(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    check(spark, fixture(random.Random(12)))


def test_short_lines_go_too(spark):
    rows = [(i, f"Share this\nonly {i} here\n   \nEnglish\n漢字の行") for i in range(5)] + [(9, "this share\nNOT english\none two three four"), (10, "one two three four five\nenglish english")]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: rows[0][1], **{i: f"only {i} here\n   " for i in range(1, 5)}, 9: "NOT english\none two three four", 10: ""}


def test_a_family_does_not_meet_in_all_pairs(spark, monkeypatch):
    draw, made, kept = random.Random(13), Counter(), lines.materialise

    def counted(df, label):
        out = kept(df, label)
        made[label] += out.count()
        return out

    monkeypatch.setattr(lines, "materialise", counted)
    base = [word(draw, (4, 9)) for _ in range(60)]
    family = [[word(draw, (4, 9)) if k == i % 60 else w for k, w in enumerate(base)] for i in range(300)]
    check(spark, [(i, " ".join(words)) for i, words in enumerate(family)])
    assert made["pairs"] < 300 * 20  # all pairs are 44850


def test_lengths_at_both_ends_of_a_band(spark):
    """Lines and others with a quarter more words, all of theirs among them."""
    draw, texts = random.Random(14), []
    for n in range(1, 130):
        words = [word(draw, (3, 12)) for _ in range(n + n // 4)]
        pair = [" ".join(words[:n]), " ".join(draw.sample(words, len(words)))]
        texts += pair if n % 2 else pair[::-1]
    check(spark, list(enumerate(texts)))


def test_small_families_are_settled_before_the_join(spark, monkeypatch):
    draw, made, kept = random.Random(15), Counter(), lines.materialise

    def counted(df, label):
        out = kept(df, label)
        made[label] += out.count()
        return out

    monkeypatch.setattr(lines, "materialise", counted)
    texts = []
    for _ in range(40):
        base = [word(draw, (4, 9)) for _ in range(40)]
        texts += [" ".join(word(draw, (4, 9)) if k == draw.randrange(40) else w for k, w in enumerate(base)) for _ in range(6)]
    check(spark, list(enumerate(texts)))
    assert made["pairs"] < 80  # 600 pairs are similar


def test_lines_with_many_words_of_their_own_meet_few_others(spark, monkeypatch):
    """Of a family whose lines differ from its base by 2 to 12 words of 60, many are like no other line, but nearly."""
    draw, made, kept = random.Random(16), Counter(), lines.materialise

    def counted(df, label):
        out = kept(df, label)
        made[label] += out.count()
        return out

    monkeypatch.setattr(lines, "materialise", counted)
    base = [word(draw, (4, 9)) for _ in range(60)]
    texts = []
    for _ in range(300):
        own = set(draw.sample(range(60), draw.randint(2, 12)))
        texts.append(" ".join(word(draw, (4, 9)) if k in own else w for k, w in enumerate(base)))
    check(spark, list(enumerate(texts)))
    assert made["pairs"] < 2000


def test_documents_of_one_id(spark):
    draw = random.Random(17)
    own = [" ".join(word(draw) for _ in range(12)) for _ in range(6)]
    rows = [(1, f"{own[0]}\n{own[1]}"), (1, f"{own[2]}\n{own[1]} more"), (1, f"{own[3]}\n{own[4]}"), (2, f"{own[4]}\n{own[5]}"), (None, own[5]), (None, own[0])]
    out = lines.dedup_lines(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in out) == 6 and len(out) == 7
    assert sorted(r.text for r in out if r.doc_id is None) == sorted([own[0], own[5]])
    assert [r.text for r in out if r.doc_id == 2] == ["", ""]
