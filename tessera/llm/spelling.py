"""Spelling variants: words one edit apart, found by walking a trie of all words with all words at once.

The trie is a table of edges (node, letter, child). A node is known by the hash of its prefix; a hash that two prefixes share only
joins their subtrees, as every pair is compared as whole words in the end. Each edge tells what lies below the child: the
lengths and the next three letters, as bits, whether the child is a word itself, and, where few words lie below, those words.
The frontier is a table of states (word, place in it, node, edits). Level by level it is joined with the edges of its nodes: a state
goes on by its own letter, or, once, by another letter, an additional one or one letter skipped. An edit is taken only at
the first letter that differs, so each pair of words has one way. A state whose bits or length don't fit is dropped before
it is shuffled; one that comes to a word with one edit used, or to a page of few words, ends in neighbours.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, checkpointed, stored, table

#: Words below a child that are kept with its edge; words of a node that share a salt; counts held before they are handed on.
PAGE, SALT, FLUSH = 16, 4096, 200_000
#: Every MISPELT-th word of a text loses a letter.
MISPELT = 199
#: Latin-1 letters from A-Z (to lower case), a-z and U+00C0 to U+00FF; all else becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def counted_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6) -> DataFrame:
    """``word, n`` of all runs of letters, each word counted once for each time it stands in a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                begun = zlib.crc32(f"{doc}:".encode() if doc is not None else b":")
                for word, n in Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split()).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if h % MISPELT == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= least:
                        found[word] += n
                if len(found) > FLUSH:
                    yield told(found)
                    found.clear()
        yield told(found)

    def told(found: Counter) -> dict:
        return {"word": [w.decode("latin-1") for w in found], "n": list(found.values())}

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bit(of: Column) -> Column:
    """One of 32 bits, as a long; the letters a to z have bits of their own."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), of.bitwiseAND(F.lit(31)))


def ahead(left: Column, c1: Column, c2: Column, c3: Column) -> tuple[Column, Column]:
    """What lies ahead as bits of two longs: how many letters, and the next three (0 past the end); lengths of 31 and more share a bit."""
    high = lambda a, b: F.call_function("shiftleft", bit(a), F.lit(32)).bitwiseOR(bit(b))
    return high(F.least(left, F.lit(31)), c1), high(c2, c3)


def letter(word: Column, at: Column) -> Column:
    """The code point at a place from 0; 0 past the end."""
    return F.ascii(F.substring(word, at + 1, F.lit(1)))


def rest(word: Column, at: Column) -> Column:
    return F.substring(word, at + 1, F.length(word))


def trie(words: DataFrame, page: int = PAGE) -> DataFrame:
    """``node, salt, letter, child, depth, salts, itself, sees, then, below, tails``: the edges down to children with up to ``page`` words below.

    Edges are sums over the prefixes of all words; those under a node with no more than ``page`` words are left out. A node
    has an edge for each letter at most, so its edges are repeated once for every ``SALT`` words below it: the words at
    the upper nodes are dealt over that many salts. ``itself`` is the child's prefix where that is a word,
    ``tails`` what the words in ``below`` have after it.
    """
    words = stored(words.select("word", F.monotonically_increasing_id().alias("number")))
    word, depth = F.col("word"), F.col("depth")
    prefix = words.select("*", F.explode(F.sequence(F.lit(1), F.length(word))).alias("depth"))
    prefix = prefix.withColumns({"child": F.xxhash64(F.substring(word, F.lit(1), depth)), "node": F.xxhash64(F.substring(word, F.lit(1), depth - 1)), "letter": letter(word, depth - 1)})
    left, edge = F.length(word) - depth, ["node", "letter", "child", "depth"]
    sees, then = ahead(left, *(letter(word, depth + j) for j in range(3)))
    edges = stored(prefix.groupBy(edge).agg(F.count("*").alias("n"), F.max(F.when(left == 0, word)).alias("itself"), F.bit_or(sees).alias("sees"), F.bit_or(then).alias("then")))
    above = edges.groupBy(F.col("child").alias("node")).agg(F.sum("n").alias("of")).filter(F.col("of") > page)
    top = edges.filter("depth = 1").withColumn("of", F.sum("n").over(Window.partitionBy("depth")))  # an edge for each letter
    edges = top.unionByName(edges.filter("depth > 1").join(above, "node"))
    small = prefix.select("number", *edge).join(edges.filter(F.col("n") <= page).select(edge), edge).join(words, "number")
    small = small.groupBy(edge).agg(F.collect_list(F.struct("word", rest(word, depth).alias("tail"))).alias("below")).select(*edge, F.col("below.word").alias("below"), F.col("below.tail").alias("tails"))
    salts = lambda n: F.ceil(n / SALT).cast("int")
    edges = edges.join(small, edge, "left").withColumns({"salts": salts(F.col("n")), "salt": F.explode(F.sequence(F.lit(0), salts(F.col("of")) - 1))})
    return stored(edges.drop("n", "of"))


def root() -> Column:
    return F.xxhash64(F.lit("")).alias("node")


def neighbours(words: DataFrame, page: int = PAGE) -> DataFrame:
    """``word, near``: all pairs of words one edit apart, both ways round, each once. ``words`` are distinct; the empty word takes no part.

    There are as many rounds as the longest prefix that more than ``page`` words share has letters, and one.
    """
    edges = trie(words, page)
    salts = max(1, -(-words.count() // SALT))
    frontier = words.select("word", F.lit(0).alias("at"), root(), F.lit(0).alias("used"), F.lit(salts).alias("salts"))
    ended: DataFrame | None = None
    while True:
        both = stored(step(frontier, edges))
        frontier, found = both.filter(F.col("near").isNull()).drop("near"), both.filter(F.col("near").isNotNull()).select("word", "near")
        ended = found if ended is None else ended.unionByName(found)
        if frontier.isEmpty():
            return ended.filter(F.levenshtein("word", "near", 1) == 1).distinct()


def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """``word, at, node, used, salts, goes_on, near``: the states one level down, and as rows with ``near`` the neighbours that this level gives."""
    word, at, size = F.col("word"), F.col("at"), F.length("word")
    left, clean = F.col("left"), F.col("used") == 0
    # What a state needs to see once it has its edit, with none, one or two letters left behind; worked out once for each state.
    states = frontier.select("*", F.pmod(F.hash("word"), F.col("salts")).alias("salt"), (size - at).alias("left"), *[letter(word, at + i).alias(f"c{i}") for i in range(5)]).drop("salts")
    needs = {f"{name}{i}": x for i in range(3) for name, x in zip(("sees", "then"), ahead(left - i, *(F.col(f"c{i + j}") for j in range(3))), strict=True)}
    states = states.withColumns(needs).drop("c2", "c3", "c4")
    # A state that has its edit asks for one edge only.
    went = states.filter("used = 0").join(edges, ["node", "salt"]).unionByName(states.filter("used = 1").withColumn("letter", F.col("c0")).join(edges, ["node", "salt", "letter"]))
    own = F.col("letter")
    same = own == F.col("c0")
    fits = [(F.col(f"sees{i}").bitwiseAND(F.col("sees")) == F.col(f"sees{i}")) & (F.col(f"then{i}").bitwiseAND(F.col("then")) == F.col(f"then{i}")) for i in range(3)]

    def move(when: Column, gone: int, used: int) -> Column:
        return F.when(when & fits[gone] if used else when, F.struct((at + gone).alias("to"), F.lit(used).alias("used")))

    skip = (left > 1) & (own == F.col("c1"))
    edited = clean & ~same
    moves = F.array(move(same, 1, 0), move(edited & (left > 0), 1, 1), move(edited, 0, 1), move(edited & skip, 2, 1))
    # A state that has its edit goes on by its own letter, a clean one as it is or with an edit.
    moves = F.when(clean, moves).otherwise(F.array(move(same, 1, 1)))
    possible = F.when(same, clean | fits[1]).otherwise(fits[0] | fits[1] | (skip & fits[2]))
    columns = ("word", "child", "salts", "depth", "itself", "below", "tails")
    went = went.filter(possible).select(*columns, F.explode(moves).alias("m")).filter(F.col("m").isNotNull()).select(*columns, F.col("m.to").alias("to"), F.col("m.used").alias("used"))
    to, used = F.col("to"), F.col("used")
    # In a page the word with the same rest, or, on the word's own way, those that may be one edit apart.
    place = F.array_position("tails", rest(word, to))
    own_page = F.filter("below", lambda w: (w != word) & (F.abs(F.length(w) - size) <= 1))
    here, on = (to + 1 - used == size) & F.col("itself").isNotNull(), (used == 0) | (to < size)
    state = F.lit(None).cast("string")
    told = (
        F.when(F.col("below").isNotNull() & (used == 1), F.when(place > 0, F.array(F.element_at("below", place.cast("int")))))
        .when(F.col("below").isNotNull(), own_page).when(here & on, F.array(F.col("itself"), state)).when(here, F.array("itself")).when(on, F.array(state))
    )
    return went.select("word", to.alias("at"), F.col("child").alias("node"), "used", "salts", F.explode(told).alias("near"))


def with_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``words(word, n)``.

    A word's form is its neighbour of largest n, the first in code-point order of several, if it is ``times`` as frequent; the root
    is where forms lead. Each form is ``times`` as frequent as the last, so ways are short, and each round doubles what it follows.
    """
    pairs = neighbours(words)
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min_by("near", F.struct(-F.col("near_n"), F.col("near")))
    near = pairs.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("most"), best.alias("best"))
    out = words.join(near, "word", "left")
    has_form = F.coalesce(F.col("most") >= times * F.col("n"), F.lit(False))
    out = checkpointed(out.select("word", F.when(has_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("most")).alias("form_n")))
    ways = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    return out.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``least`` letters or more that occurs ``often`` or more.

    A null text has no words; a null id counts as an empty one, repeated rows as texts of their own. Words of any length
    take part. Ties go to the smaller word. Texts without words and empty tables give no rows; further columns are
    left out, whatever their names.
    """
    words = checkpointed(counted_words(documents, id_col, text_col, least).filter(F.col("n") >= often))
    return with_forms(words, times)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 byte by byte, each bit by bit; neighbours by the words less one letter.
OP13_SQL = """
WITH r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM r GROUP BY doc_id, run),
z AS (SELECT list(c ORDER BY k) AS crc FROM (
  SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END) AS c FROM range(256) t(k))),
h AS (
  SELECT run, n, length(run) AS len, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(b), 2), lambda k: ('0x' || substr(b, k::INT, 2))::BIGINT)),
    lambda x, y: xor(x // 256, crc[1 + xor(x, y) % 256])), 4294967295) AS h FROM g, z),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len)::INT) || substr(run, (h % len)::INT + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, k, substr(word, 1, k::INT - 1) || substr(word, k::INT + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS most, first(near ORDER BY near_n DESC, near) AS best FROM p GROUP BY word),
o AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN best END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM w LEFT JOIN f USING (word)),
t AS (WITH RECURSIVE t AS (SELECT word, word AS root, 0 AS i FROM o UNION ALL SELECT t.word, o.form, i + 1 FROM t JOIN o ON t.root = o.word AND o.form IS NOT NULL) SELECT word, arg_max(root, i) AS root FROM t GROUP BY word)
SELECT o.word, form, root, n, n_near, form_n FROM o JOIN t USING (word)
"""
