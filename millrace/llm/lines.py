"""Line dedup by an exact set-similarity join, in SQL functions only.

A line's tokens are its distinct words (what spaces part, in lower case); lines without words stay. A
line goes if an earlier one, by doc_id (null first), line number and text, has a Jaccard similarity of at least
`SHARE` (4/5) with it, whether that one stays or not.

Equal lines: all but the first go, and only the first is compared with others. Tokens are ordered from long words to
short ones, as long words are rare, and by hash (any order gives exact results). Two lines of n and m tokens that are
similar share one of their first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 tokens. Of two lines the shorter one needs
a prefix of n - ceil(8/9 n) + 1 only. Lines meet under a token and a band of lengths: the longer line is in its own
band, the shorter one in its own and, by the fewer tokens that lines of that length leave it, in the next. Pairs
that meet must pass the length filter, the positional filter and a
parity filter: the 64 parities of their token sets (128 of lines of more than `LONG`) differ in no more bits than the sets
may differ in elements. What passes is verified on the lines' words.

A family of many similar lines would meet in all pairs. So each line first meets the earliest lines, one of each of `PARTS`
salted parts, of those that share two of its `LEADING` first tokens, next to each other or but one (of `MORE_PARTS`, where
more than `HOT` lines share them), and is compared with the one of these that is before it and has the nearest parities.
Where `SEVERAL` lines share them, it does the same with the line of each part that is nearest to the part's first, as that
has few words of its own. A line that proves similar is settled and need meet no other earlier line. Then every pair meets
whose later line is not settled.

A place is an id, a line number and, if any id repeats, a hash of the text.

Null texts stay null; empty texts and empty tables give themselves. A very long text is many lines, or one of many
tokens: nothing is cut. Equal places cannot tie, as rows that repeat both id and text are one document and get one
result. Columns other than id and text are not read, and a column of docs named n_removed is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, small, table

LEAST = 1
#: Salted parts of the lines that share two of so many first tokens, each of which has a first line; parts of more than HOT lines.
PARTS = 4
MORE_PARTS = 24
HOT = 1024
LEADING = 4
#: Of lines of at most LONG tokens, only so many.
SHORT_LEADING = 3
#: From so many lines on that share two first tokens, the line nearest to the first is used too.
SEVERAL = 16
#: Bits of a word's hash in its rank; those above tell its length, up to LONGEST bytes, from long to short.
BITS = 58
LONGEST = 31
#: From so many pairs on, each line is compared with the first that it meets before all others.
MANY = 1 << 20
#: Lines of more tokens have 128 parities instead of 64.
LONG = 48
#: Of lengths in one band. Over 1.25, so that similar lines are in one band or in two that are neighbours.
RATIO = 1.6
#: Of a token and a band, so many bits are shuffled; others that have them are told apart by the filters.
KEY_BITS = 31


def words_of(line: Column) -> Column:
    """Hashes of the distinct words of a line that is in lower case."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))


def text_mark(docs: DataFrame, doc_id: str, text: str) -> Column:
    """What tells documents of one id apart: 31 bits of the text's hash; 0 if no id repeats, which shuffles fewer bytes."""
    repeats = docs.groupBy(docs[doc_id]).count().filter("count > 1").limit(1).count() > 0
    return F.xxhash64(docs[text]).bitwiseAND(F.lit(0x7FFFFFFF)) if repeats else F.lit(0).cast("bigint")


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, at, line): lines in lower case that may have enough tokens; at is the line number and 31 bits, mark, of the document."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("mark").alias("h"), F.posexplode(F.split(F.lower("text"), "\n")).alias("i", "line"))
    return rows.filter(F.octet_length("line") >= 2 * LEAST - 1).select("id", (F.col("i").cast("bigint") * F.lit(1 << 31) + F.col("h")).alias("at"), "line")


def rank(word: Column) -> Column:
    """64 bits that order words from long to short, then by hash."""
    shorter = F.lit(LONGEST) - F.least(F.octet_length(word), F.lit(LONGEST))
    return F.shiftleft(shorter.cast("bigint"), BITS).bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit((1 << BITS) - 1)))


def needed(n: Column) -> Column:
    """ceil(0.8 n)"""
    return F.ceil(n * 4 / F.lit(5.0) - 1e-9).cast("int")


def records(lines: DataFrame) -> DataFrame:
    """(id, at, again, n, par, half, keys, prefix, band, least, beyond) of lines: prefix is KEY_BITS of each of their first tokens by rank.

    par is 64 parities, half those of one half of the tokens of long lines, keys are hashes of each two of the first
    tokens that are at most one apart, band is the band of lengths; of the shorter line of a pair, least tokens are needed, and beyond for lines of the
    next band. Lines that come again have none of them, and
    n tells only whether they have words. Lines without are there too: a filter here would have each line cut twice.
    """
    empty = rank(F.lit(""))
    ranked = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), rank)), empty)
    rows = lines.select("id", "at", "again", (F.length(F.trim("line")) > 0).alias("any"), F.when(~F.col("again"), F.sort_array(ranked)).alias("ranked"))
    n = F.when(F.col("again"), F.col("any").cast("int")).otherwise(F.size("ranked"))
    rows = rows.select("id", "at", "again", n.alias("n"), "ranked")
    bits = [F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)]
    fold = lambda table, mask: F.aggregate("ranked", F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(F.array(*table)[t.bitwiseAND(F.lit(mask))]))
    nothing = F.lit(0).cast("bigint")
    par, half = fold(bits, 63), F.when(F.col("n") > LONG, fold([nothing] * 64 + bits, 127)).otherwise(nothing)
    prefix = F.slice("ranked", F.lit(1), F.col("n") - needed(F.col("n")) + 1)
    prefix = F.transform(prefix, lambda t: t.bitwiseAND(F.lit((1 << KEY_BITS) - 1)).cast("int"))
    first = [F.get("ranked", F.lit(i)) for i in range(LEADING)]
    pairs = [(k, k + d) for d in (1, 2) for k in range(LEADING - d)]
    keys = F.array_compact(F.array(*(F.when(F.col("n") > (last if last < SHORT_LEADING else LONG), F.xxhash64(first[k], first[last])) for k, last in pairs)))
    n = F.greatest(F.col("n"), F.lit(1))
    left = lambda least_needed: F.greatest(n - least_needed.cast("int") + 1, F.lit(0))
    longer = F.ceil(F.pow(F.lit(RATIO), band(n) + 1) * (1 - 1e-9))  # lines of the next band are at least so long
    least, beyond = left(F.ceil(n * 8 / F.lit(9.0) - 1e-9)), left(F.ceil((n + longer) * 4 / F.lit(9.0) - 1e-9))
    lengths = band(n).alias("band"), least.alias("least"), beyond.alias("beyond")
    return rows.select("id", "at", "again", "n", par.alias("par"), half.alias("half"), keys.alias("keys"), prefix.alias("prefix"), *lengths)


def band(n: Column) -> Column:
    """The band of lengths that n is in."""
    return F.floor(F.log(n) / F.log(F.lit(RATIO)))


def tokens_of(first: DataFrame, shorter: bool) -> DataFrame:
    """(id, at, par, half, ni, key) of the prefixes of lines, as the shorter or the longer ones of pairs.

    ni is the length, a bit that tells whether the line is settled, and the token's place; key is of the token and a band of
    lengths.
    """
    high = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.when(F.col("settled"), F.lit(1 << 31)).otherwise(F.lit(0)))
    columns = [F.col("id"), F.col("at"), F.col("par"), F.col("half")]
    prefix = F.slice("prefix", F.lit(1), F.col("least")) if shorter else F.col("prefix")
    # Spark works out what stands beside an explode for each of its rows
    rows = first.select(*columns, "n", "settled", "band", "beyond", F.posexplode(prefix).alias("i", "token"))
    rows = rows.select(*columns, high.alias("high"), "band", "beyond", "i", "token")
    own, after = (F.col("token").bitwiseXOR(F.shiftleft(F.col("band") + by, KEY_BITS - 6)).cast("bigint") for by in (0, 1))
    key = F.explode(F.when(F.col("i") < F.col("beyond"), F.array(own, after)).otherwise(F.array(own))) if shorter else own
    return rows.select(*columns, (F.col("high") + F.col("i")).alias("ni"), key.alias("key"))


def odd(n: Column, m: Column, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """In how many bits the parities, by name, of lines of n and m tokens differ."""
    par, half = (x(c).bitwiseXOR(y(c)) for c in ("par", "half"))
    return F.when(F.least(n, m) > LONG, F.bit_count(half) + F.bit_count(par.bitwiseXOR(half))).otherwise(F.bit_count(par))


def may_share(k: Column, n: Column, m: Column) -> Column:
    """Whether lines of n and m tokens that share at most k can be similar, as they can from 4/9 of n + m on."""
    return 9 * k >= 4 * (n + m)


def alike(n: Column, m: Column, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether parities, by name, of lines of n and m tokens and their lengths allow that they are similar."""
    # n + m - odd is even, twice the tokens that they share at most
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * odd(n, m, x, y) <= n + m)


def settle(docs: DataFrame, first: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """(id, at) of lines that are like an earlier one, the first or the nearest to it of a part of those that share two of their first tokens."""
    shared = first.select(F.explode("keys").alias("shared")).groupBy("shared").agg(F.count("*").alias("k")).filter("k > 1").select("shared", F.when(F.col("k") > HOT, MORE_PARTS).otherwise(PARTS).alias("parts"), (F.col("k") >= SEVERAL).alias("several"))
    shared = materialise(shared, "shared")
    heads = first.select("id", "at", "par", "half", "n", F.explode("keys").alias("key"))
    heads = materialise(heads.join(small(shared), F.col("key") == F.col("shared")).drop("shared"), "settling")
    part, line = F.pmod(F.xxhash64("id", "at"), F.col("parts")).alias("part"), ("id", "at", "par", "half", "n")
    place, hub = (F.struct(F.col(f"{s}id").alias("id"), F.col(f"{s}at").alias("at")) for s in ("", "hub_"))
    lengths = F.col("hub_n"), F.col("n"), lambda c: F.col(f"hub_{c}"), F.col
    named = lambda hubs: hubs.select(F.col("key").alias("hub_key"), F.col("part").alias("hub_part"), *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in line))

    def nearest(hubs: DataFrame) -> DataFrame:
        both = heads.join(small(hubs), (F.col("key") == F.col("hub_key")) & (hub < place) & alike(*lengths))
        x = both.groupBy("id", "at").agg(F.min(F.struct(odd(*lengths).alias("odd"), F.col("hub_id").alias("id"), F.col("hub_at").alias("at"))).alias("x"))
        return x.select(F.col("x.id").alias("x_id"), F.col("x.at").alias("x_at"), F.col("id").alias("y_id"), F.col("at").alias("y_at"))

    hubs = materialise(named(heads.groupBy("key", part).agg(F.min(F.struct(*line)).alias("hub"))), "hubs")
    # of the lines of a part, the one nearest to the first has the fewest words of its own
    others = heads.filter("several").withColumn("part", part).join(small(hubs), (F.col("key") == F.col("hub_key")) & (F.col("part") == F.col("hub_part")) & (hub < place) & alike(*lengths))
    middle = others.groupBy("key", "part").agg(F.min(F.struct(odd(*lengths).alias("odd"), *line)).alias("hub"))
    middle = materialise(named(middle), "middle")
    met_first = materialise(nearest(hubs).union(nearest(middle)).distinct(), "met_first")
    settled = materialise(verified(docs, met_first, scratch).select(F.col("y_id").alias("id"), F.col("y_at").alias("at")).distinct(), "settled")
    scratch += [shared, heads, hubs, middle, met_first, settled]
    return settled


def met(first: DataFrame) -> DataFrame:
    """(x_id, x_at, y_id, y_at), x the earlier: pairs of lines that share a key and pass the filters, their later line not settled."""
    x, y = (tokens_of(first, shorter).withColumnsRenamed({c: f"{s}_{c}" for c in ("id", "at", "par", "half", "ni", "key")}) for s, shorter in (("x", True), ("y", False)))
    n, m = (F.shiftright(f"{s}_ni", 32) for s in "xy")
    i, j = (F.col(f"{s}_ni").bitwiseAND(F.lit((1 << 31) - 1)) for s in "xy")
    settled_x, settled_y = (F.col(f"{s}_ni").bitwiseAND(F.lit(1 << 31)) != 0 for s in "xy")
    x_place, y_place = (F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_at").alias("at")) for s in "xy")
    fits = (n <= m) & may_share(F.least(n - i, m - j), n, m) & alike(n, m, lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}")) & ((n < m) | (x_place < y_place))
    fits = fits & ~F.when(x_place < y_place, settled_y).otherwise(settled_x)  # settled lines need no earlier line
    pairs = x.join(y, (F.col("x_key") == F.col("y_key")) & fits)
    before, after = F.least(x_place, y_place), F.greatest(x_place, y_place)
    return pairs.select(before["id"].alias("x_id"), before["at"].alias("x_at"), after["id"].alias("y_id"), after["at"].alias("y_at")).distinct()


def by_numbers(text: Column, numbers: Column, use) -> Column:
    """use(lines, numbers) of a text's lines, which are cut once: a column named in a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), numbers.alias("numbers"))), lambda s: use(s["lines"], s["numbers"])), F.lit(0))


def verified(docs: DataFrame, pairs: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """The pairs (x_id, x_at, y_id, y_at) whose lines are similar by their words (64-bit hashes). Their texts are cut again."""
    wanted = pairs.select(F.col("x_id").alias("id"), F.col("x_at").alias("at")).union(pairs.select("y_id", "y_at")).distinct()
    per_doc = materialise(wanted.groupBy("id", F.col("at").bitwiseAND(F.lit(0x7FFFFFFF)).alias("h")).agg(F.collect_list("at").alias("ats")), "wanted")
    rows = docs.join(small(per_doc), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("h")))
    line = lambda lines: lambda at: F.struct(at.alias("at"), F.get(lines, F.shiftright(at, 31).cast("int")).alias("line"))
    cut = rows.select("id", F.explode(by_numbers(F.col("text"), F.col("ats"), lambda lines, ats: F.transform(ats, line(lines)))).alias("x"))
    words = materialise(cut.select("id", "x.at", words_of(F.lower("x.line")).alias("words")), "words")
    scratch += [per_doc, words]
    if words.count() > (per_doc.agg(F.sum(F.size("ats"))).first()[0] or 0):
        words = materialise(words.dropDuplicates(["id", "at"]), "words")  # repeated rows give one line each
        scratch.append(words)
    left = words.select(F.col("id").alias("i"), F.col("at").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("id").alias("j"), F.col("at").alias("b"), F.col("words").alias("y"))
    joined = pairs.join(left, F.col("x_id").eqNullSafe(F.col("i")) & (F.col("x_at") == F.col("a"))).join(right, F.col("y_id").eqNullSafe(F.col("j")) & (F.col("y_at") == F.col("b")))
    both = F.size(F.array_intersect("x", "y"))
    return joined.filter(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select("x_id", "x_at", "y_id", "y_at")


def later_lines(docs: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """(id, at), some of them again, of every line that an earlier one makes go. scratch: gets the tables that its rows come from."""
    place = F.struct("id", "at")
    lines = lines_of(docs).withColumns({"s1": F.xxhash64("line"), "s2": F.xxhash64(F.lit(7), "line")})
    sets = lines.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count("*").alias("k"))
    repeated = materialise(sets.filter("k > 1").select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), "first"), "repeated")
    marked = lines.join(small(repeated), (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")), "left")
    again = F.col("r1").isNotNull() & ~F.col("first").eqNullSafe(place)
    every = materialise(records(marked.select("id", "at", "line", again.alias("again"))), "records")
    enough = every.filter(F.col("n") >= LEAST)
    equal, first = enough.filter("again").select("id", "at"), enough.filter("NOT again")
    settled = settle(docs, first, scratch)
    discard(*(df for df in scratch if df is not settled))  # and the shuffle files so far, before the largest
    done = small(settled.select(F.col("id").alias("d"), F.col("at").alias("a"), F.lit(True).alias("settled")))
    first = first.join(done, F.col("id").eqNullSafe(F.col("d")) & (F.col("at") == F.col("a")), "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    gone = equal.union(settled)

    pairs = materialise(met(first), "pairs")
    scratch += [repeated, every, pairs]
    y_of = lambda df: df.select(F.col("y_id").alias("id"), F.col("y_at").alias("at"))
    if pairs.count() < MANY:
        return gone.union(y_of(verified(docs, pairs, scratch)))
    # most lines have an earlier like one in the first that they meet; only what is left is compared with the others
    first_met = pairs.groupBy("y_id", "y_at").agg(F.min(F.struct("x_id", "x_at")).alias("x"))
    first_met = materialise(first_met.select("x.x_id", "x.x_at", "y_id", "y_at"), "first_met")
    similar = materialise(y_of(verified(docs, first_met, scratch)), "similar")
    done = small(similar.select(F.col("id").alias("d"), F.col("at").alias("a")))
    others = pairs.join(done, F.col("y_id").eqNullSafe(F.col("d")) & (F.col("y_at") == F.col("a")), "left_anti")
    others = materialise(others, "others")
    scratch += [first_met, similar, others]
    return gone.union(similar).union(y_of(verified(docs, others, scratch)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """All columns of docs, the text without the lines that go, and n_removed; a column named by size gets the new length."""
    mark = text_mark(docs, doc_id, text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), mark.alias("mark"))
    scratch: list[DataFrame] = []
    gone = later_lines(slim, scratch).groupBy("id", F.col("at").bitwiseAND(F.lit(0x7FFFFFFF)).alias("h")).agg(F.collect_set(F.shiftright("at", 31).cast("int")).alias("gone"))
    gone = materialise(gone.withColumnsRenamed({"id": "_id", "h": "_h", "gone": "_gone"}), "gone")
    discard(*scratch)
    joined = docs.join(small(gone), docs[doc_id].eqNullSafe(F.col("_id")) & (mark == F.col("_h")), "left")
    left = lambda lines, gone: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    rest = F.array_join(by_numbers(docs[text], F.col("_gone"), left), "\n")
    new = F.when(F.col("_gone").isNull(), docs[text]).otherwise(rest)
    shorter = {text: new} | ({size: F.when(F.col("_gone").isNull(), docs[size]).otherwise(F.length(new))} if size in docs.columns else {})
    columns = [shorter.get(c, docs[c]).alias(c) for c in docs.columns if c != "n_removed"]
    return joined.select(*columns, F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = rf"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), places AS (
  SELECT doc_id, i, list_distinct(list_filter(string_split(lower(l[i]), ' '), lambda w : w <> '')) AS words
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM cut)
), lines AS (
  SELECT row_number() OVER (ORDER BY doc_id, i) AS k, * FROM places WHERE len(words) >= 1
), sets AS (
  SELECT min(k) AS k, any_value(words) AS words, any_value(len(words)) AS n FROM lines GROUP BY list_sort(words)
), tokens AS (
  SELECT k, n, unnest(words) AS t FROM sets
), ranked AS (
  SELECT k, n, t, row_number() OVER (PARTITION BY k ORDER BY df, t) AS p FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM tokens)
), prefix AS (
  SELECT * FROM ranked WHERE p <= n - ceil(0.8 * n - 1e-9) + 1
), pairs AS (
  SELECT DISTINCT a.k AS x, b.k AS y FROM prefix a JOIN prefix b ON a.t = b.t AND a.k < b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), similar_ AS (
  SELECT DISTINCT y FROM (SELECT y, len(list_intersect(a.words, b.words)) AS c, a.n + b.n AS s FROM pairs JOIN sets a ON a.k = x JOIN sets b ON b.k = y) WHERE 5 * c >= 4 * (s - c)
), gone AS (
  SELECT doc_id, list(i) AS g FROM lines WHERE k NOT IN (SELECT k FROM sets) OR k IN (SELECT y FROM similar_) GROUP BY doc_id
)
SELECT c.doc_id, CASE WHEN g IS NULL THEN text ELSE coalesce(list_aggregate([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(g, i)], 'string_agg', chr(10)), '') END AS text,
  CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed
FROM cut c LEFT JOIN gone ON gone.doc_id = c.doc_id
"""
