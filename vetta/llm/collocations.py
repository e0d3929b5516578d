"""Phrase collocation mining by vertical partitioning of suffixes.

Phrases of 2 to ``longest`` words are counted as nodes of a depth-truncated
suffix tree over the words of each language, which is never held whole:

1. Words are counted.  A word that occurs more than ``budget`` times is *hot*.
2. The suffix that begins at a word occurrence belongs to a prefix: its first
   word, or, while the words so far are hot, one word more.  A prefix that is
   not the whole suffix therefore has ``budget`` occurrences at most.  Prefixes
   are grouped under the budget: heavy ones by a table (the least loaded group
   first), all others by hash into as many groups as the total asks for.
3. Every task sends each different suffix of a slice once, with its count, to
   the group of its prefix.  A group is one task's work: its suffixes are
   sorted level by level, which gives its subtrees, and a node's count is the
   sum of the counts of its leaves.
4. Nodes above a prefix (of hot words only) are spread over groups; their
   partial counts, like all others, are summed by Spark.

Scores come from exact integers: the products are decimals of 38 digits.

Defined cases: a null text counts as empty, a null language as ``und``; a
language without words gives no rows; a text of one piece or of any length is
sliced by rows, so it is one slice; equal rows count each; ties are broken as
stated in ``collocations``; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta.llm.common import staged
from vetta.llm.words import LOWER, byte_slices, split_words, splitmix, text_buffer, word_hashes

LONGEST = 3                     # words of a candidate at most
LEAST = 10                      # occurrences of a candidate
TOP = 2000                      # phrases reported of each language
BUDGET = 500_000                # suffixes of a group
HEAVY = 16                      # a prefix of more than budget / HEAVY suffixes is placed by the table
TABLE_ROWS = 100_000            # rows of the table of heavy words, and of a broadcast table of counts
SLICE_BYTES = 2 << 20           # text handled at once in a task
UNKNOWN = "und"
SPACE, LINE, EMPTY = (pa.scalar(x, pa.large_string()) for x in (" ", "\n", ""))


def _pieces_map() -> np.ndarray:
    t = LOWER.copy()
    t[[ord(c) for c in ".,;:!?"]] = 0x0A
    return t


PIECES = _pieces_map()          # A-Z in lower case, what ends a piece as 0x0A


def _texts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]):
    """(language, text column) of rows of one language, about ``SLICE_BYTES`` of text."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").take(pa.array(np.flatnonzero(codes == k)))
            for begin, end in byte_slices(texts, SLICE_BYTES):
                yield lang, texts.slice(begin, end - begin)


def _coded(w) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the words by code."""
    size = w.end - w.start
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1          # a word may begin where another ends (two rows)
    data = w.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(size)))
    words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def _lang_hash(h: np.ndarray, lang: str) -> np.ndarray:
    return splitmix(h ^ splitmix(np.array([zlib.crc32(lang.encode()) + 1], dtype=np.uint64)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n) of single words; every slice sums its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, col in _slices(batches):
            codes, words = _coded(split_words(col, PIECES))
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()), pa.array(n)],
                                             names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Groups:
    """Group of each prefix: heavy words by a table of bounded size, others by hash."""

    def __init__(self, heavy: list[tuple[str, str, int]], total: int, budget: int):
        self.n = max(1, -(-total // budget))
        self.budget = budget
        light = total - sum(n for _, _, n in heavy)
        loads = [(light // self.n, g) for g in range(self.n)]
        heapq.heapify(loads)
        place = {}
        for lang, word, n in sorted(heavy, key=lambda x: (-x[2], x[0], x[1])):
            h = int(self.hashes([word], lang)[0])
            if n > budget:
                place[h] = -1                   # hot: prefixes go on
            elif h not in place:
                load, g = heapq.heappop(loads)
                heapq.heappush(loads, (load + n, g))
                place[h] = g
        self.known = np.array(sorted(place), dtype=np.uint64)
        self.place = np.array([place[h] for h in sorted(place)], dtype=np.int64)

    @staticmethod
    def hashes(words: list[str], lang: str) -> np.ndarray:
        """Hash of each word of a language (equal to that inside texts)."""
        return _lang_hash(word_hashes(split_words(pa.array(words), None)), lang)

    def of(self, hashes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and prefix length of suffixes, given the hashes of their words
        (a row each) and which words exist; one more where a piece ends within
        hot words, since longer suffixes with those words are in other groups."""
        depth = hashes.shape[1]
        group = np.zeros(len(hashes), dtype=np.int64)
        size = np.zeros(len(hashes), dtype=np.int64)
        open_, key = np.ones(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.uint64)
        for j in range(depth):
            h = hashes[:, j]
            key = splitmix(key * np.uint64(31) + h)
            spot = np.full(len(h), -2, dtype=np.int64)          # -2: a light word
            if len(self.known):
                at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
                spot = np.where(self.known[at] == h, self.place[at], -2)
            ends = ~valid[:, j + 1] if j + 1 < depth else np.ones(len(h), dtype=bool)
            stop = open_ & ((spot != -1) | ends)
            by_hash = (key % np.uint64(self.n)).astype(np.int64)
            group[stop] = np.where((j == 0) & (spot >= 0), spot, by_hash)[stop]
            size[stop] = np.where((spot == -1) & (j + 1 < depth), j + 2, j + 1)[stop]
            open_ &= ~stop
        return group, size


def _columns(codes: np.ndarray, piece: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of the suffix at each word (-1 beyond its piece)."""
    n = len(codes)
    out = np.full((n, depth), -1, dtype=np.int64)
    out[:, 0] = codes
    for j in range(1, min(depth, n)):
        same = piece[j:] == piece[:-j]
        out[:n - j, j][same] = codes[j:][same]
    return out, out >= 0


def _ranks(columns: np.ndarray) -> list[np.ndarray]:
    """For each level, the number of the node above which a row hangs, nodes in
    sorted order (the levels of the suffix tree)."""
    out, node = [], np.zeros(len(columns), dtype=np.int64)
    for j in range(columns.shape[1]):
        width = int(columns[:, j].max(initial=0)) + 2
        node = np.unique(node * width + columns[:, j] + 1, return_inverse=True)[1]
        out.append(node)
    return out


def suffix_rows(texts: DataFrame, groups: Groups, longest: int) -> DataFrame:
    """(part, lang, prefix, data, counts): the different suffixes of a slice that
    belong to one group, as lines of words, and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, col in _slices(batches):
            w = split_words(col, PIECES)
            if not len(w.start):
                continue
            codes, words = _coded(w)
            breaks = np.cumsum((w.data >= 0x0A) & (w.data <= 0x0D))
            columns, valid = _columns(codes, w.row * (int(breaks[-1]) + 1) + breaks[w.start], longest)
            leaf = _ranks(columns)[-1]
            first = np.full(int(leaf.max()) + 1, -1, dtype=np.int64)
            first[leaf[::-1]] = np.arange(len(leaf))[::-1]
            counts = np.bincount(leaf)
            h = _lang_hash(word_hashes(w), lang)
            ahead = np.minimum(first[:, None] + np.arange(longest), len(h) - 1)
            group, prefix = groups.of(h[ahead], valid[first])
            order = np.lexsort((np.arange(len(first)), prefix, group))
            first, counts, group, prefix = first[order], counts[order], group[order], prefix[order]
            take = [words.take(pa.array(columns[first, j], mask=~valid[first, j])) for j in range(longest)]
            lines = pc.binary_join_element_wise(*take, SPACE, null_handling="skip")
            lines = pc.binary_join_element_wise(lines, EMPTY, LINE)
            data, offsets = text_buffer(lines)
            at = np.concatenate(([0], np.flatnonzero((np.diff(group) != 0) | (np.diff(prefix) != 0)) + 1, [len(group)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(group[at[:-1]]), pa.array([lang] * (len(at) - 1), pa.string()), pa.array(prefix[at[:-1]].astype(np.int32)),
                pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets[at]), pa.py_buffer(data)]).cast(pa.binary()),
                pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)),
                                                                pa.py_buffer(counts.astype("<i8"))])],
                names=["part", "lang", "prefix", "data", "counts"])

    return texts.mapInArrow(run, "part long, lang string, prefix int, data binary, counts binary")


NODES = "lang string, phrase string, size int, n long"


def subtrees(longest: int, least: int):
    """Builds the subtrees of a group and gives the nodes of two words and more;
    nodes at or below a prefix are whole, so rare ones go at once."""
    def run(table: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            for prefix in pc.unique(own.column("prefix")).to_pylist():
                rows = own.filter(pc.equal(own.column("prefix"), prefix))
                counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype="<i8")
                lines = pa.array([b"".join(rows.column("data").to_pylist())], pa.large_binary()).view(pa.large_string())
                w = split_words(lines, None)
                codes, words = _coded(w)
                line = np.cumsum(w.data == 0x0A)[w.start]
                begin = np.searchsorted(line, np.arange(len(counts)))
                depth = np.diff(np.concatenate((begin, [len(codes)])))
                columns = np.full((len(counts), longest), -1, dtype=np.int64)
                for j in range(longest):
                    has = depth > j
                    columns[has, j] = codes[begin[has] + j]
                for j, node in enumerate(_ranks(columns)[1:], start=1):
                    total = np.zeros(int(node.max(initial=-1)) + 1, dtype=np.int64)
                    np.add.at(total, node, counts)
                    first = np.zeros(len(total), dtype=np.int64)
                    first[node] = np.arange(len(node))
                    keep = columns[first, j] >= 0
                    if j + 1 >= prefix:
                        keep &= total >= least
                    first = first[keep]
                    phrase = pc.binary_join_element_wise(*[words.take(pa.array(columns[first, i])) for i in range(j + 1)], SPACE)
                    n = len(first)
                    out.append(pa.table({"lang": pa.array([lang] * n, pa.string()), "phrase": phrase.cast(pa.string()),
                                         "size": pa.array(np.full(n, j + 1, np.int32)), "n": pa.array(total[keep])}))
        return pa.concat_tables(out) if out else pa.table({
            "lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    return run


def largest(counts: DataFrame, threshold: int, limit: int = TABLE_ROWS) -> tuple[DataFrame, int]:
    """Rows of ``counts`` (a staged table) above a threshold, which is doubled
    until there are ``limit`` rows at most; and the threshold."""
    while (some := counts.where(F.col("n") > threshold)).count() > limit:
        threshold *= 2
    return some, threshold


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                  least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Staged tables of word counts (lang, phrase, n) and of the counts of all
    phrases of 2 to ``longest`` words that occur ``least`` times
    (lang, phrase, size, n)."""
    texts = _texts(df, text_col, lang_col)
    words = staged(word_counts(texts), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    heavy, threshold = largest(words, max(1, budget // HEAVY))
    groups = Groups([tuple(r) for r in heavy.collect()], total, max(budget, threshold))
    rows = suffix_rows(texts, groups, longest)
    nodes = rows.groupBy("part").applyInArrow(subtrees(longest, least), NODES)
    phrases = nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, staged(phrases, "phrases")


def _looked_up(rows: DataFrame, keys: dict[str, str], counts: DataFrame, often: DataFrame, threshold: int) -> DataFrame:
    """``rows`` with the counts of the phrases in the columns ``keys`` (new column:
    key).  Counts above the threshold are broadcast (their number is bounded) and
    the rows staged; any other phrase is part of few candidates, so the joins on
    what is still missing have no hot key."""
    def on(t: DataFrame, key: str, out: str, how: str, table: DataFrame) -> DataFrame:
        named = table.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_key"), F.col("n").alias(out))
        named = F.broadcast(named) if how == "left" else named
        return t.join(named, (F.col("lang") == F.col("_lang")) & (F.col(key) == F.col("_key")), how).drop("_lang", "_key")

    for out, key in keys.items():
        rows = on(rows, key, out, "left", often)
    rows = staged(rows, "cuts")
    seldom, done = counts.where(F.col("n") <= threshold), None
    for known in itertools.product([True, False], repeat=len(keys)):
        part = rows.where(functools.reduce(Column.__and__, [F.col(c).isNotNull() if k else F.col(c).isNull() for c, k in zip(keys, known)]))
        for (out, key), k in zip(keys.items(), known):
            part = part if k else on(part.drop(out), key, out, "inner", seldom)
        done = part if done is None else done.unionByName(part)
    return done


def _sub_phrases(size: int) -> Column:
    """The phrases of 2 words and more inside the longer phrase of a row."""
    words = F.split("phrase", " ")
    return F.array(*[F.array_join(F.slice(words, i + 1, n), " ") for n in range(2, size) for i in range(size - n + 1)])


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                 least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """The ``top`` phrases of each language by their weakest cut: ``lang``,
    ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``; ties by more
    occurrences, then by the bytes of the phrase.  A phrase goes where a longer
    candidate holds it that has half of its occurrences at least."""
    words, phrases = phrase_counts(df, text_col, lang_col, longest, least, budget)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counts = words.where(F.col("n") >= least).unionByName(phrases.drop("size"))
    # a phrase that occurs f times is part of f / least candidates on each side at most
    often, threshold = largest(counts, least * TABLE_ROWS)

    inside = None
    for size in range(3, longest + 1):
        own = phrases.where(F.col("size") == size).select("lang", F.explode(_sub_phrases(size)).alias("phrase"), F.col("n").alias("longer"))
        inside = own if inside is None else inside.unionByName(own)
    alone = phrases
    if inside is not None:
        inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        alone = phrases.join(inside, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * 50)).drop("longer")

    cuts = alone.withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    cuts = _looked_up(cuts, {"l": "first", "r": "rest"}, counts, often, threshold)
    exact = {c: f"cast({c} as decimal(18,0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
                                           F.col("total").alias("n"), "score")
