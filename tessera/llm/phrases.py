"""Phrase collocation mining with pivot partitioning: text fragments travel to the rarest word of their n-grams and are mined there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import cut, small_batches, with_group

PIECE = 1 << 20
#: Bytes that end a piece: . , ; : ! ? and U+000A..U+000D.
STOPS = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
#: Seeds of the rows of the table of word counts.
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gap(data: np.ndarray) -> np.ndarray:
    return STOPS[data] | (data == 0x20) | (data == 0x09)


class Words:
    """The words of some texts of one language: lower-cased bytes, places, pieces and 64-bit hashes (never 0)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0):
        self.data = k.lower_ascii(data)
        self.start, self.end, text = k.words(self.data, offsets, gap)
        self.piece = np.concatenate([[0], np.cumsum(STOPS[self.data])])[self.start] + text  # grows wherever a stop or the end of a text lies between two words
        h = k.mix(k.Prefix(self.data ^ np.uint8(seed % 256)).range(self.start, self.end)) if len(self.start) else np.zeros(0, np.uint64)
        self.hash = np.maximum(h, np.uint64(1))

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at the given numbers as strings."""
        length = self.end[at] - self.start[at]
        data = self.data[ranges(self.start[at], length)]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then start[1], ..."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def by_language(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, Words]]:
    """The words of each language of a batch of (lang, text), in runs of whole texts."""
    langs = k.column(batch, "lang")
    texts = k.column(batch, "text")
    for lang in pc.unique(langs).to_pylist():
        own = texts.filter(pc.equal(langs, lang))
        data, offsets = k.bytes_of(own)
        for a, b in k.pieces(offsets, PIECE):
            yield lang, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], seed)


def lines(lang: str, columns: dict) -> list[pa.RecordBatch]:
    t = pa.table(columns)
    return t.add_column(0, "lang", pa.array([lang] * len(t), pa.string())).combine_chunks().to_batches(max_chunksize=10_000)


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, x, phrase, n) of every word of texts(lang, text), x its hash; each batch sends a word once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in by_language(batch, seed):
                if len(words.start):
                    t = pa.table({"phrase": words.texts(np.arange(len(words.start))), "x": words.hash.view(np.int64)}).group_by(["phrase", "x"], use_threads=False).aggregate([([], "count_all")])
                    yield from lines(lang, {"x": t["x"], "phrase": t["phrase"], "n": t["count_all"]})
        k.rest()

    return texts.mapInArrow(count, "lang string, x long, phrase string, n long").groupBy("lang", "x", "phrase").agg(F.sum("n").alias("n"))


def cells(hashes: np.ndarray, lang: str, bits: int) -> list[np.ndarray]:
    """A word's cell in each row of the table of counts."""
    own = k.Prefix(np.frombuffer(lang.encode() + b" ", np.uint8)).range(np.array([0]), np.array([len(lang.encode()) + 1]))[0]
    return [(k.mix((hashes ^ own) * s) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64) for s in SEEDS]


def rarity(frequent: DataFrame, bits: int) -> np.ndarray:
    """Two rows of 2**bits cells: the greatest count of the frequent words (lang, x, n) in each cell; 0 where there is none.

    A word's rarity is the smaller of its two cells: its count, but for words that share both cells with more frequent ones. The
    tasks combine cells before the shuffle; the result has 2 * 2**bits numbers of 8 bytes, whatever the number of words.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, n, x = k.column(batch, "lang"), k.column(batch, "n").to_numpy(), k.column(batch, "x").to_numpy().view(np.uint64)
            for lang in pc.unique(langs).to_pylist():
                own = pc.equal(langs, lang).to_numpy(zero_copy_only=False)
                at = np.concatenate([c + (i << bits) for i, c in enumerate(cells(x[own], lang, bits))])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(n[own], len(SEEDS)))], names=["cell", "n"])

    out = np.zeros(len(SEEDS) << bits, np.int64)
    for r in frequent.select("lang", "x", "n").mapInArrow(place, "cell long, n long").groupBy("cell").agg(F.max("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    return out.reshape(len(SEEDS), -1)


#: A fragment: the pivot p and up to two words on either side, as hashes, 0 where there is none.
PLACES = ("l2", "l1", "p", "r1", "r2")


def fragments(words: Words, lang: str, table: np.ndarray) -> pa.Table | None:
    """(l2, l1, p, r1, r2, n): each word with the neighbours that its n-grams may reach, equal fragments once with their number.

    An n-gram belongs to its rarest word, the leftmost of equal ones: to the left a fragment reaches over words that are more frequent,
    to the right over words that are not rarer, up to two words each way and within the piece. Words that are not frequent
    end a fragment.
    """
    bits = int(table.shape[1]).bit_length() - 1
    count = np.minimum(*(row[c] for row, c in zip(table, cells(words.hash, lang, bits), strict=True)))
    n, tie = len(count), words.hash

    def rarer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at a are rarer than those at b."""
        return (count[a] < count[b]) | ((count[a] == count[b]) & (tie[a] < tie[b]))

    at = np.flatnonzero(count > 0)
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for far in (1, 2):
        i = np.flatnonzero((left == far - 1) & (at >= far))
        there = at[i] - far
        left[i[(words.piece[there] == words.piece[at[i]]) & rarer(at[i], there)]] = far
        i = np.flatnonzero((right == far - 1) & (at + far < n))
        there = at[i] + far
        right[i[(count[there] > 0) & (words.piece[there] == words.piece[at[i]]) & ~rarer(there, at[i])]] = far
    some = (left > 0) | (right > 0)
    at, left, right = at[some], left[some], right[some]
    if not len(at):
        return None
    h = words.hash.view(np.int64)
    held = {0: np.ones(len(at), bool), -1: left > 0, -2: left > 1, 1: right > 0, 2: right > 1}
    columns = {name: np.where(held[d], h[np.clip(at + d, 0, n - 1)], 0) for name, d in zip(PLACES, (-2, -1, 0, 1, 2), strict=True)}
    return pa.table(columns).group_by(list(PLACES), use_threads=False).aggregate([([], "count_all")])


def routed(texts: DataFrame, table: np.ndarray, seed: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in by_language(batch, seed):
                t = fragments(words, lang, shared.value)
                if t is not None:
                    yield from lines(lang, {**{c: t[c] for c in PLACES}, "n": t["count_all"]})
        k.rest()

    return texts.mapInArrow(route, "lang string, " + ", ".join(f"{c} long" for c in PLACES) + ", n long")


def frequent_phrases(texts: DataFrame, table: np.ndarray, least: int, seed: int) -> DataFrame:
    """(lang, x, y, z, n) of the phrases of two and three words (z is 0 for two) that occur at least `least` times.

    Fragments are dealt by language and pivot; each pivot's n-grams are counted where its fragments are, without another shuffle.
    """
    dealt = routed(texts, table, seed).repartition("lang", "p")
    none, c = F.lit(0).cast("long"), F.col

    def gram(x: str, y: str, z: str | None = None) -> Column:
        ends = [c(w) != 0 for w in (x, z or y)]
        return F.when(ends[0] & ends[1], F.struct(c(x).alias("x"), c(y).alias("y"), (c(z) if z else none).alias("z")))

    grams = dealt.select("lang", "p", "n", F.explode(F.array(gram("l1", "p"), gram("p", "r1"), gram("l2", "l1", "p"), gram("l1", "p", "r1"), gram("p", "r1", "r2"))).alias("g")).where("g is not null")
    counted = grams.select("lang", "p", "n", "g.x", "g.y", "g.z").groupBy("lang", "p", "x", "y", "z").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("lang", "x", "y", "z", "n")


def parts(kept: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """kept(lang, x, y, z, a) with its words' texts and counts and, for three words, the counts of its first and last two.

    All parts are looked up in one join; those that very many phrases share are broadcast (see with_group), never gathered.
    """
    none, c = F.lit(0).cast("long"), F.col
    wanted = [("x", "x", none), ("y", "y", none), ("z", "z", none), ("xy", "x", c("y")), ("yz", "y", c("z"))]
    part = lambda name, x, y: F.struct(F.lit(name).alias("name"), c(x).alias("_x"), y.alias("_y"))
    e = F.explode(F.when(c("z") == 0, F.array(*[part(*w) for w in wanted[:2]])).otherwise(F.array(*[part(*w) for w in wanted])))
    rows = kept.select("lang", "x", "y", "z", "a", e.alias("_e")).select("lang", "x", "y", "z", "a", "_e.name", F.struct("lang", "_e._x", "_e._y").alias("_part"))
    groups = rows.groupBy("_part").agg(F.count("*").alias("_rows")).join(known.select(F.struct("lang", c("x").alias("_x"), c("y").alias("_y")).alias("_part"), "phrase", "n"), "_part")
    found = with_group(rows, cut(groups), "_part", "_rows", total)
    at = lambda name, value: F.max(F.when(c("name") == name, c(value)))
    return found.groupBy("lang", "x", "y", "z", "a").agg(*[at(n, "phrase").alias(f"t_{n}") for n in "xyz"], *[at(n, "n").alias(f"n_{n}") for n, *_ in wanted])


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, best: int = 2000, cover: int = 50, bits: int = 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two and three words that hold together best.

    Texts (null: empty) are lower-cased (A-Z), cut at .,;:!? and U+000A..U+000D into pieces and these at spaces and tabs into words; a
    null language counts as `und`. a, l and r are the occurrences of a phrase and of its two parts, n those of all words of the language;
    the score is the floor of 1,000,000 a a / (l r), for the cut into parts where it is lowest. Phrases of at least `least` occurrences
    count; one that lies in a longer one with at least `cover` per cent of its occurrences is left out. Ranked by score, a and phrase.

    Words are counted first, under 64-bit hashes that are taken anew if two words should share one; those below `least` end every fragment. How rare a word is comes from a broadcast table of 2 * 2**bits
    cells filled with the counts of all frequent words: words that share their cells with more frequent ones may hand an n-gram to
    another of its words, always the same one, so that counts stay exact. Empty tables and tables without frequent phrases give
    an empty result; repeated rows count as often as they come; columns other than the two are not read.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seed, c = 0, F.col
    while True:
        words = word_counts(texts, seed)
        # The frequent words, and beside them how often the others of a language occur and how many distinct words and hashes it has.
        often = c("n") >= least
        hashes = words.groupBy("lang", "x").agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.max("phrase").alias("phrase"))
        counts = cut(hashes.groupBy("lang", F.when(often, c("x")).alias("x"), F.when(often, c("phrase")).alias("phrase")).agg(F.sum("n").alias("n"), F.max("words").alias("words")))
        if (counts.agg(F.max("words")).first()[0] or 1) == 1:
            break
        seed += 1  # two words share a hash: other hashes
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where("x is not null").select("lang", "x", "phrase", "n")
    phrases = cut(frequent_phrases(texts, rarity(frequent, bits), least, seed))
    total = phrases.count()
    none = F.lit(0).cast("long")
    known = frequent.select("lang", "x", none.alias("y"), "phrase", "n").unionByName(phrases.where("z = 0").select("lang", "x", "y", F.lit(None).cast("string").alias("phrase"), "n"))
    longer = phrases.where("z <> 0").select("lang", F.inline(F.array(F.struct("x", "y"), F.struct(c("y").alias("x"), c("z").alias("y")))), none.alias("z"), none.alias("a"), c("n").alias("inside"))
    covered = phrases.select("lang", "x", "y", "z", c("n").alias("a"), none.alias("inside")).unionByName(longer)
    kept = covered.groupBy("lang", "x", "y", "z").agg(F.max("a").alias("a"), F.max("inside").alias("inside")).where((c("a") > 0) & (100 * c("inside") < cover * c("a"))).drop("inside")
    known_parts = parts(kept, known, 5 * total)
    wide = lambda x: c(x).cast("decimal(19,0)")

    def score(left: str, right: str) -> Column:
        million = F.lit(1_000_000).cast("decimal(7,0)")
        return F.struct(F.call_function("div", wide("a") * wide("a") * million, wide(left) * wide(right)).alias("score"), F.lit(left).alias("k"), c(left).alias("l"), c(right).alias("r"))

    two, first, second = score("n_x", "n_y"), score("n_x", "n_yz"), score("n_xy", "n_z")
    best_cut = F.when(c("z") == 0, two).otherwise(F.when(first["score"] <= second["score"], first).otherwise(second))
    scored = known_parts.select("lang", F.concat_ws(" ", "t_x", "t_y", "t_z").alias("phrase"), "a", best_cut.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    return ranked(scored, best, total).join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(scored: DataFrame, best: int, total: int) -> DataFrame:
    """scored with rank, the first `best` of each language: of each part of a language first, so that no task orders all its phrases.

    There are as many parts as make a part about as large as the parts' first rows together.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(1, round((total / best) ** 0.5))))
    first = scored.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= best).drop("_r", "_part")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
